"""refrain: loop, jump and vote analytics over whole audio catalogues on Spark."""
