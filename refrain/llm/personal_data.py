"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Patterns give candidate spans: the strict pattern of each kind, whose valid matches are
   base spans and always stay, and looser ones (spelt-out addresses, bare phone numbers,
   short card numbers and so on).  Positions are running sums over the pieces between matches.
2. Four labelers vote for, against or not at all on each candidate: its format (checksum,
   ranges), gazetteers (top-level domains, issuers, country codes), cue words before it, and
   the characters around it.  The strict pattern is a fifth one.
3. Expectation-maximisation estimates, per kind, how reliable each labeler is, from the counts
   of vote patterns (at most 3**5 a kind, however many candidates there are); base spans are
   known to be true.
4. Its posteriors are the labels of a naive Bayes classifier over the votes, the shape, the
   length and the neighbourhood of a span, trained by one grouped sum.  Candidates to which EM
   gives ``threshold`` or more, and the classifier at least even odds, are added where they
   overlap no base span.

DataFrame functions only: the iterations of EM are a fold over an array, in one row per kind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.llm.registry import query, table
from refrain.operators.settle import settle

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "format", "gazetteer", "context", "boundary")
#: Characters kept on each side of a candidate.
BEFORE, AFTER = 48, 8
#: Rounds of EM, and the made-up votes that set each labeler's direction before any data does.
ROUNDS = 40
_PSEUDO_RIGHT, _PSEUDO_WRONG = 8.0, 2.0
#: Made-up spans by which the classifier draws each feature's rate among true and false spans towards its rate among all.
_SMOOTHING = 8.0
#: Hash buckets of words and shapes in the classifier.
_WORDS, _SHAPES = 256, 64


@dataclass(frozen=True)
class Pattern:
    """One source of candidates.  ``strict`` matches that are valid are base spans.

    Every text with a match contains ``mark`` and a match of ``hint``, which are cheaper to look for.
    """

    name: str
    kind: str
    regex: str
    mark: str = ""
    hint: str = ""
    strict: bool = False


_LOCAL = "[A-Za-z0-9._%+-]"
_OPEN, _CLOSE = r"[\[({]\x20?", r"\x20?[\])}]"
#: The strict patterns are those of the contract, started only where a match can start and without
#: backtracking, so that a text of one long run takes linear time.  A number that is too long or too
#: short for a card is never valid, so the strict card pattern names the lengths at once.
PATTERNS = (
    Pattern("email", "email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", strict=True),
    Pattern("ip", "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"[0-9]\.[0-9]", strict=True),
    Pattern("card", "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", "", r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", strict=True),
    Pattern("phone", "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", strict=True),
    Pattern(
        "email_spelt", "email",
        rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+\x20?{_OPEN}(?i:at|@){_CLOSE}\x20?[A-Za-z0-9-]{{1,63}}+(?:\x20?(?:{_OPEN}(?i:dot|\.){_CLOSE}|\.)\x20?[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
        "", rf"{_OPEN}(?i:at|@)",
    ),
    Pattern("ip_defanged", "ip", rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_OPEN}(?i:dot|\.){_CLOSE}[0-9]{{1,3}}+){{3}}(?![0-9])", "", rf"[0-9]{_OPEN}(?i:dot|\.){_CLOSE}"),
    Pattern("ip_long", "ip", r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])", ":", r":[0-9A-Fa-f]{1,4}:"),
    Pattern("card_short", "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", "", r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"),
    Pattern("card_dotted", "card", r"(?<![0-9./_])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_])", "", "[0-9]{4}[./_]"),
    Pattern("phone_bare", "phone", r"(?<![0-9+(.-])(?:00[0-9]{1,3}+[\x20.-]?)?+\(?[0-9]{3}\)?[\x20.-]{1,2}+[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", "", r"[0-9]{3}[\x20.-][0-9]{4}"),
)

# Gazetteers and cue words.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "int", "mil", "info", "io", "co", "de", "fr", "es", "it", "uk", "eu", "ch", "at", "nl", "us", "ca", "mx", "br", "ru", "cn", "jp", "in", "au")
FILE_ENDINGS = ("png", "jpg", "jpeg", "gif", "svg", "js", "css", "py", "html", "pdf", "txt", "so")
ISSUERS = r"^(?:4[0-9]{12}|4[0-9]{15}|4[0-9]{18}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|6(?:011|22[0-9]|4[4-9][0-9]|5[0-9]{2})[0-9]{12,15}|35[0-9]{14})$"
COUNTRY_CODES = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
BARE_NUMBER = r"^\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9]"
UNROUTED = r"^(?:0|10|127|255|169\.254|192\.168)\."
CUES = {
    "email": r"(?:e-?mail|mail(?:to)?|contact|write to|address|kontakt|correo|courriel|adresse)\W{0,4}(?:\w+\W{1,3}){0,3}$",
    "ip": r"(?:\bips?\b|host|server|address|client|peer|addr|adresse|direcci.n|serveur)\W{0,4}(?:\w+\W{1,3}){0,3}$",
    "card": r"(?:card|visa|mastercard|amex|credit|debit|kreditkarte|karte|tarjeta|carte)\W{0,4}(?:\w+\W{1,3}){0,3}$",
    "phone": r"(?:phone|\btel\b|telephone|call|mobile|cell|fax|telefon|handy|anruf|tel.fono|t.l.phone|m.vil)\W{0,4}(?:\w+\W{1,3}){0,3}$",
}
AGAINST = r"(?:version|\bv|release|order|invoice|isbn|issn|serial|\bsha\d*|md5|token|hash|build|section|\bid|\bno|ticket|timestamp)\W{0,4}$"


def _found(text: Column, p: Pattern) -> Column:
    """Matches of one pattern in order, each with the length of the piece before it and what stands around it."""
    pieces, matches = F.split(text, p.regex, -1), F.regexp_extract_all(text, F.lit(p.regex), F.lit(0))
    around = F.arrays_zip(matches.alias("value"), pieces.alias("piece"), F.slice(pieces, 2, F.size(pieces)).alias("next"))
    kept = F.transform(
        F.slice(around, 1, F.size(matches)),
        lambda x, i: F.struct(
            F.lit(p.name).alias("pattern"), i.alias("i"), x["value"].alias("value"), F.char_length(x["piece"]).cast("long").alias("gap"),
            F.right(x["piece"], F.lit(BEFORE)).alias("before"), F.left(x["next"], F.lit(AFTER)).alias("after"),
        ),
    )
    seen = text.rlike(p.regex)
    if p.hint:
        seen = text.rlike(p.hint) & seen
    return F.when(text.contains(p.mark) & seen if p.mark else seen, kept)


def candidates(rows: DataFrame) -> DataFrame:
    """One row per candidate: row, pattern, kind, start, end (code points, end exclusive), value, before, after, base, the labelers' votes.

    ``rows`` has row (unique), and ``found`` as :func:`scanned` gives it.
    """
    each = rows.select("row", F.explode("found").alias("x")).select("row", "x.*").withColumn("width", F.char_length("value").cast("long"))
    earlier = Window.partitionBy("row", "pattern").orderBy("i")
    upto, past = earlier.rowsBetween(Window.unboundedPreceding, 0), earlier.rowsBetween(Window.unboundedPreceding, -1)
    start = F.sum("gap").over(upto) + F.coalesce(F.sum("width").over(past), F.lit(0))
    placed = each.repartition("row").withColumn("start", start).withColumn("end", F.col("start") + F.col("width"))
    return voted(placed).drop("i", "gap", "width")


def scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns but the text, with ``row`` and ``found``: the matches of all patterns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.flatten(F.array_compact(F.array(*[_found(text, p) for p in PATTERNS])))
    return docs.select(*[c for c in docs.columns if c != text_col], F.monotonically_increasing_id().alias("row"), found.alias("found"))


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    padded = F.lpad(digits, 19, "0")
    total = F.lit(0)
    for i in range(19):
        d = F.ascii(F.substring(padded, 19 - i, 1)) - 48
        total += d if i % 2 == 0 else 2 * d - F.when(d > 4, 9).otherwise(0)
    return total % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1 where ``yes``, -1 where ``no`` (by default, where not), else 0."""
    against = F.lit(-1) if no is None else F.when(no, -1).otherwise(0)
    return F.when(yes, 1).otherwise(against)


def voted(df: DataFrame) -> DataFrame:
    """Add kind, base and one column of votes per labeler to rows of pattern, value, before and after."""
    kind_of = F.create_map(*[F.lit(x) for p in PATTERNS for x in (p.name, p.kind)])
    df = df.withColumn("kind", kind_of[F.col("pattern")]).withColumn("digits", F.regexp_replace("value", "[^0-9]", ""))
    value, kind, digits = F.col("value"), F.col("kind"), F.col("digits")
    n = F.length(digits)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    separator = r"(?:\.|[\[({]\x20?(?i:dot|\.)\x20?[\])}])"
    is_ip = value.rlike(rf"^{octet}(?:{separator}{octet}){{3}}$")
    fits = {
        "email": value.rlike(r"(?:\.|[\])}])\x20?[A-Za-z]{2,24}$"),
        "ip": is_ip | (F.col("pattern") == "ip_long"),
        "card": F.when(n <= 19, luhn(digits)).otherwise(False),
        "phone": n.between(8, 15),
    }
    top = F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1))
    known = {
        "email": _vote(top.isin(*TOP_DOMAINS), top.isin(*FILE_ENDINGS)),
        "ip": F.when(F.col("pattern") == "ip_long", 0).otherwise(F.when(value.rlike(UNROUTED), -1).otherwise(1)),
        "card": _vote(digits.rlike(ISSUERS)),
        "phone": _vote(value.rlike(COUNTRY_CODES) | value.rlike(BARE_NUMBER)),
    }
    said = F.lower("before")
    cue = {k: said.rlike(c) for k, c in CUES.items()}
    joined = F.right("before", F.lit(1)).rlike(r"[\p{L}0-9=_/#@\"']") | F.left("after", F.lit(1)).rlike(r"[\p{L}0-9=_/#@\"']")

    def by_kind(of: dict[str, Column]) -> Column:
        out = F.when(kind == KINDS[0], of[KINDS[0]])
        for k in KINDS[1:]:
            out = out.when(kind == k, of[k])
        return out

    valid = by_kind(fits | {"email": F.lit(True)})
    strict = F.col("pattern").isin(*[p.name for p in PATTERNS if p.strict])
    return df.withColumns(
        {
            "base": strict & valid,
            "strict": F.when(strict, _vote(valid)).otherwise(0),
            "format": _vote(by_kind(fits)),
            "gazetteer": by_kind(known),
            "context": _vote(by_kind(cue), said.rlike(AGAINST)),
            "boundary": F.when(joined, -1).otherwise(1),
        }
    ).drop("digits")


def reliabilities(votes: DataFrame) -> DataFrame:
    """One row per kind: kind, prior, right and wrong (P(vote for | true), P(vote for | false) of each labeler that votes).

    ``votes`` has kind, base and the labelers' columns.  An abstaining labeler says nothing.
    """
    patterns = votes.groupBy("kind", "base", *LABELERS).agg(F.count(F.lit(1)).cast("double").alias("n"))
    listed = patterns.groupBy("kind").agg(
        F.array_sort(F.collect_list(F.struct(F.array(*LABELERS).alias("votes"), "base", "n"))).alias("patterns")
    )
    rate = _PSEUDO_RIGHT / (_PSEUDO_RIGHT + _PSEUDO_WRONG)
    flat = lambda r: F.array(*[F.lit(r)] * len(LABELERS))
    start = F.struct(F.lit(0.5).alias("prior"), flat(rate).alias("right"), flat(1 - rate).alias("wrong"))

    def step(model: Column, _: Column) -> Column:
        scored = F.transform(
            "patterns", lambda x: F.struct(x["votes"].alias("votes"), (x["n"] * posterior(x, model)).alias("t"), (x["n"] * (1 - posterior(x, model))).alias("f"))
        )
        total = lambda of: F.aggregate(scored, F.lit(0.0), lambda a, x: a + of(x))

        def rates(mass: str, right: float, wrong: float) -> Column:
            of = lambda j, v: total(lambda x: F.when(x["votes"][j] == v, x[mass]).otherwise(0.0))
            return F.array(*[(of(j, 1) + right) / (of(j, 1) + of(j, -1) + right + wrong) for j in range(len(LABELERS))])

        true, false = total(lambda x: x["t"]), total(lambda x: x["f"])
        return F.struct(
            ((true + 1) / (true + false + 2)).alias("prior"), rates("t", _PSEUDO_RIGHT, _PSEUDO_WRONG).alias("right"), rates("f", _PSEUDO_WRONG, _PSEUDO_RIGHT).alias("wrong")
        )

    return listed.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step).alias("model")).select("kind", "model.*")


def posterior(x: Column, model: Column) -> Column:
    """P(true) of votes ``x`` (votes, base) under a model (prior, right, wrong); base spans are true."""
    odds = F.log(model["prior"] / (1 - model["prior"]))
    for j in range(len(LABELERS)):
        right, wrong, vote = model["right"][j], model["wrong"][j], x["votes"][j]
        odds += F.when(vote == 1, F.log(right / wrong)).when(vote == -1, F.log((1 - right) / (1 - wrong))).otherwise(0.0)
    return F.when(x["base"], F.lit(1.0)).otherwise(1 / (1 + F.exp(-odds)))


def _features() -> Column:
    """What the classifier sees of a candidate, as strings of a bounded vocabulary."""
    shape = F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), r"\p{L}+", "a")
    word = F.lower(F.regexp_extract("before", r"(\p{L}+)[^\p{L}]*$", 1))
    side = lambda c: F.when(c == "", "end").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\s"), "space").otherwise("mark")
    named = {
        **{v: F.col(v).cast("string") for v in LABELERS[1:]},
        "pattern": F.col("pattern"),
        "length": F.least(F.floor(F.log2(F.char_length("value").cast("double"))), F.lit(8)).cast("string"),
        "shape": F.pmod(F.xxhash64(shape), F.lit(_SHAPES)).cast("string"),
        "word": F.pmod(F.xxhash64(word), F.lit(_WORDS)).cast("string"),
        "left": side(F.right("before", F.lit(1))),
        "right": side(F.left("after", F.lit(1))),
    }
    return F.array(*[F.concat(F.lit(f"{name}="), c) for name, c in named.items()])


def span_classifier(labelled: DataFrame) -> DataFrame:
    """One row per kind: kind, bias and weights (log odds by feature), from rows of kind, features and posterior."""
    mass = lambda c: F.sum(c).alias
    t, f = F.col("posterior"), 1 - F.col("posterior")
    totals = labelled.groupBy("kind").agg(mass(t)("all_true"), mass(f)("all_false"))
    by_feature = labelled.select("kind", F.explode("features").alias("feature"), "posterior").groupBy("kind", "feature").agg(mass(t)("is_true"), mass(f)("is_false"))
    share = _SMOOTHING * (F.col("is_true") + F.col("is_false")) / (F.col("all_true") + F.col("all_false"))  # a rare feature says little
    weight = F.log((F.col("is_true") + share) / (F.col("all_true") + _SMOOTHING)) - F.log((F.col("is_false") + share) / (F.col("all_false") + _SMOOTHING))
    weighed = by_feature.join(F.broadcast(totals), "kind")  # a row per kind
    return weighed.groupBy("kind").agg(
        F.first(F.log((F.col("all_true") + 1) / (F.col("all_false") + 1))).alias("bias"),
        F.map_from_entries(F.collect_list(F.struct("feature", weight.alias("weight")))).alias("weights"),
    )


def personal_data(docs: DataFrame, text_col: str = "text", threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).  ``rows`` has every row's other columns and ``row``; ``spans`` has row, kind, start, end, value, base, posterior, probability.

    Positions count code points; ``end`` is exclusive.  Base spans are the valid matches of the
    strict patterns, leftmost and non-overlapping per kind.  Added spans have a posterior of
    ``threshold`` and a probability of 0.5 or more, overlap no base span, and start after the end of all likely
    candidates before them.  Null and empty texts have no spans; texts are read whole;
    repeated rows are judged each; an empty table gives empty results.  Columns of ``docs``
    named row or found must be renamed before.
    """
    rows = settle(scanned(docs, text_col))
    seen = settle(candidates(rows))
    model = settle(reliabilities(seen))  # a row per kind
    votes = F.struct(F.array(*LABELERS).alias("votes"), "base")
    labelled = seen.join(F.broadcast(model), "kind").withColumn("posterior", posterior(votes, F.struct("prior", "right", "wrong")))
    labelled = labelled.drop("prior", "right", "wrong").withColumn("features", _features())
    classifier = settle(span_classifier(labelled.select("kind", "features", "posterior")))  # a row per kind, of bounded size
    log_odds = F.aggregate("features", F.col("bias"), lambda a, f: a + F.coalesce(F.col("weights")[f], F.lit(0.0)))
    judged = labelled.join(F.broadcast(classifier), "kind").withColumn("probability", 1 / (1 + F.exp(-log_odds)))
    likely = judged.where(F.col("base") | (F.col("posterior") >= threshold) & (F.col("probability") >= 0.5))
    by_start = Window.partitionBy("row").orderBy("start", F.col("base").desc(), F.col("end").desc(), "kind", "pattern")
    before, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)
    free = (F.coalesce(F.max("end").over(before), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(F.when(F.col("base"), F.col("start"))).over(after) >= F.col("end"), F.lit(True))
    )
    kept = likely.withColumn("free", F.col("base") | free).where("free")
    return rows.drop("found"), kept.select("row", "kind", "start", "end", "value", "base", "posterior", "probability")


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    listed = spans.groupBy("row").agg(
        *[F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.struct(order.alias("order"), "start", name.alias("name"), "base"))).alias("spans"),
    )
    names = lambda spans: F.array_join(F.transform(spans, lambda s: s["name"]), ",")
    return rows.join(listed, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce(names(F.filter("spans", lambda s: s["base"])), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(names("spans"), F.lit("")).alias("spans"),
    )
