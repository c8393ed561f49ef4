"""Explicit schemas (DDL text) of the tables the library reads or writes, and shared vocabularies."""

from __future__ import annotations

# Vocabularies shared with existing logs and documents.
BAR_LENGTHS = (1, 2, 4, 8, 16)
VOTE_BAR_LENGTHS = (1, 2, 4, 6, 8, 12, 16)
FEELS = ("exploration", "tension", "combat", "intensity", "stinger")
RATINGS = ("good", "bad", "clear")
ANALYSIS_VERSION = "phase-closure-v1"
SONG_MAP_VERSION = "song-map-v2"
GAME_SONG_VERSION = "game-song-v1"
AUDIO_EXTENSIONS = ("mp3", "wav", "flac", "ogg", "m4a", "aac")
STEM_LABELS = {
    "base": "Drums + bass",
    "top": "Vocals + other",
    "drums": "Drums",
    "bass": "Bass",
    "other": "Other",
    "vocals": "Vocals",
}

PCM_CHUNK = (
    "song_id string, channel int, chunk_idx bigint, start_sample bigint, sample_rate int, samples array<float>"
)
FRAME = (
    "song_id string, hop_idx bigint, t_sec double, chroma array<double>, timbre array<double>, "
    "spec array<double>, rms double, centroid double, flux double"
)
BEAT = "song_id string, beat_idx int, t_sec double"

LOOP_VOTE_JSON = (
    "at string, sourceName string, startSec double, endSec double, bars double, seamScore double, "
    "contextScore double, homogeneityScore double, qualityScore double, closureScore double, bpm double, "
    "vibeWindowSec double, rating string, note string, tags array<string>, analysisVersion string, "
    "wrapCrossfadeSec double, normalize boolean"
)
WRAP_VOTE_JSON = (
    "version double, at string, sourceName string, exitSec double, entrySec double, fadeSec double, rating string"
)
PACK_VOTE_JSON = (
    "sourceName string, rating string, join struct<kind: string, exitSec: double, entrySec: double>"
)
PACK_DOCUMENT_JSON = "jumps array<struct<exitSec: double, entrySec: double, source: string>>"
