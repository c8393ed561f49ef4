"""Allow and block rules on urls by a sort-merge range join.

A rule is a host and a path prefix; it fits its host and all subdomains.  Host labels are
reversed into a canonical key (``www.example.com`` becomes ``com|example|www|``), so the
subdomains of a host are one interval of keys.  Pages and rules are cut into slabs of the
key order by sampled splitters, each rule going to every slab its interval meets, and each
slab is sorted; one sweep then keeps a stack of the rules whose interval is open and judges
each page against the stack.
"""

from __future__ import annotations

import bisect
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm.registry import query, table

_LABEL_END = "\x01"
_INTERVAL_END = "\x02"
#: Slabs per shuffle partition, the most slabs, and sampled keys per slab.
_SLABS = 8
_MOST_SLABS = 20_000
_SAMPLE = 20

SWEPT = "page_id {id}, host string, path string, rule string, verdict string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host from the first ``://`` on, A-Z lower-cased; path up to ``?`` or ``#``.  Null or no ``://``: both empty."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the top domain down, each closed by one low character."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _LABEL_END), F.lit(_LABEL_END))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (host and path of the deciding rule, else null), verdict.

    ``rules`` has columns host, path and verdict.  The longest fitting rule (host and path
    together) decides; of equally long ones that with the longer host.  Of rules that name
    host and path twice, the block wins.  Rules with a null host, path or verdict fit nothing.
    A page without a fitting rule, also one with a null url, gets ``default``.  Repeated
    pages are judged each.  The rules of one host are held in one task.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    keyed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn(
        "key", F.concat(host_key(F.col("host")), F.lit("\x00"), F.col("path"), F.lit("\x00"), F.lower(F.hex(F.xxhash64("page_id"))))
    )
    splitters = sample_splitters(keyed, "key", _slab_count(spark))

    @F.pandas_udf("int")
    def slab(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect.bisect_right(splitters, k)).astype("int32")

    page_rows = keyed.select(
        slab("key").alias("slab"), "key", F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict")
    )
    named = rules.dropna(subset=["host", "path", "verdict"]).groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"))
    intervals = named.withColumn("key", host_key(F.col("host"))).withColumn(
        "end", F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(_INTERVAL_END))
    )
    rule_rows = intervals.select(
        F.explode(F.sequence(slab("key"), slab("end"))).alias("slab"), "key", F.lit(0).alias("kind"), F.lit(None).cast(keyed.schema["page_id"].dataType).alias("page_id"),
        "host", "path", F.when(F.col("block"), "block").otherwise("allow").alias("verdict"),
    )
    sorted_slabs = page_rows.unionByName(rule_rows).repartition("slab").sortWithinPartitions("slab", "key", "kind")
    schema = SWEPT.format(id=keyed.schema["page_id"].dataType.simpleString())
    return sorted_slabs.mapInPandas(_sweeper(default), schema).withColumnRenamed("page_id", id_col)


def _slab_count(spark: SparkSession) -> int:
    return min(_MOST_SLABS, _SLABS * int(spark.conf.get("spark.sql.shuffle.partitions")))


def sample_splitters(df: DataFrame, key: str, slabs: int) -> list[str]:
    """At most ``slabs`` - 1 keys that cut ``df`` into about equal parts, from a sample of about ``_SAMPLE * slabs`` keys."""
    n = df.count()
    fraction = min(1.0, _SAMPLE * slabs / max(n, 1))
    keys = sorted(r[0] for r in df.select(key).sample(fraction=fraction, seed=7).collect())
    return sorted({keys[len(keys) * i // slabs] for i in range(1, slabs)}) if keys else []


class _Frame:
    """The rules of one host while its interval is open."""

    def __init__(self, host: str, key: str):
        self.host, self.end = host, key[:-1] + _INTERVAL_END
        self.paths: dict[str, str] = {}
        self.lengths: list[int] = []

    def add(self, path: str, verdict: str) -> None:
        self.paths[path] = verdict
        at = bisect.bisect_left(self.lengths, len(path))
        if at == len(self.lengths) or self.lengths[at] != len(path):
            self.lengths.insert(at, len(path))

    def longest(self, path: str) -> str | None:
        for n in self.lengths[bisect.bisect_right(self.lengths, len(path)) - 1 :: -1] if self.lengths and self.lengths[0] <= len(path) else ():
            if path[:n] in self.paths:
                return path[:n]
        return None


def _sweeper(default: str):
    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[_Frame] = []
        current = None
        for batch in batches:
            out = []
            for slab, key, kind, page_id, host, path, verdict in zip(
                batch["slab"], batch["key"], batch["kind"], batch["page_id"], batch["host"], batch["path"], batch["verdict"], strict=True
            ):
                if slab != current:
                    stack, current = [], slab
                while stack and stack[-1].end <= key:
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].host != host:
                        stack.append(_Frame(host, key))
                    stack[-1].add(path, verdict)
                    continue
                best, won = None, default
                for frame in reversed(stack):
                    if (fit := frame.longest(path)) is not None and (best is None or len(frame.host) + len(fit) > len(best)):
                        best, won = frame.host + fit, frame.paths[fit]
                out.append((page_id, host, path, best, won))
            yield pd.DataFrame(out, columns=["page_id", "host", "path", "rule", "verdict"]).astype({"page_id": batch["page_id"].dtype if out and not batch["page_id"].isna().any() else object})

    return sweep


#: The rules the query applies.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(
    "op4_url_filter",
    r"""
    WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
    parts AS (
        SELECT page_id,
               translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ), fits AS (
        SELECT page_id, host, path, h || p AS rule, v AS verdict, length(h) + length(p) AS n, length(h) AS nh
        FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    ), best AS (
        SELECT * FROM fits QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, nh DESC) = 1
    )
    SELECT parts.page_id, parts.host, parts.path, best.rule, coalesce(best.verdict, 'allow') AS verdict
    FROM parts LEFT JOIN best USING (page_id)
    """,
)
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
