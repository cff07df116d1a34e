"""URL filters: host and path rules, and exact membership by a cascade of Bloom filters.

Level 0 holds the listed keys; level 1 the keys of the universe that level 0 lets through by mistake;
level 2 the listed keys that level 1 lets through by mistake; and so on until a level makes no
mistake. A key of the universe is listed exactly when the first level without it is an odd one.
The filters travel as binary literals in the plan, so pages are judged without a join. Where they would be
too large for one plan, keys are dealt into parts by a hash, each with a cascade of its own over its part of
the universe, and each part's pages are judged by its cascade.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commitloom import scratch

#: Bits for a key, and hash functions, of each level.
BITS_PER_KEY, HASHES = 12, 6
#: Bytes of filters that one part's listed keys and first level's mistakes take, about: keys are dealt into parts accordingly.
MOST_BYTES = 8 << 20
#: The share of other keys that a level lets through, about.
MISTAKEN = 0.005


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, earlier ones first among equals; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.text)).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    bits: int
    data: bytes

    def holds(self, key: Column, level: int) -> Column:
        """Whether this level lets the key through."""
        places = F.array(*[F.pmod(F.xxhash64(F.lit(level * HASHES + h), key), F.lit(self.bits)) for h in range(HASHES)])
        byte = lambda at: F.conv(F.hex(F.substring(F.lit(self.data), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.forall(places, lambda at: F.getbit(byte(at), F.pmod(at, F.lit(8)).cast("int")) == 1)


def build_level(keys: DataFrame, count: int, level: int) -> Level:
    """A filter of ``keys`` (one column, key); its words are OR-ed on the executors, then gathered."""
    bits = max(64, -(-count * BITS_PER_KEY // 64) * 64)
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(level * HASHES + h), "key"), F.lit(bits)) for h in range(HASHES)]))
    words = (
        keys.select(at.alias("at"))
        .select(F.shiftright("at", 5).alias("word"), F.expr("shiftleft(1L, cast(at % 32 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
    )
    data = bytearray(bits // 8)
    for word, bit in words.toLocalIterator():
        data[word * 4 : word * 4 + 4] = int(bit).to_bytes(4, "little")
    return Level(bits, bytes(data))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that tell listed keys of ``universe`` from the others, both with one column, key, of
    distinct strings, listed ones being part of the universe."""
    spark = listed.sparkSession
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    levels: list[Level] = []
    written: list[str] = []
    left = inside.count()
    while left:
        levels.append(made := build_level(inside, left, len(levels)))
        passed, path = scratch.keep(outside.where(made.holds(F.col("key"), len(levels) - 1)))
        written.append(path)
        inside, outside = passed, inside
        left = inside.count()
    for path in written:
        scratch.drop(spark, path)
    return levels


def parts_of(listed: int, every: int) -> int:
    """Into how many parts keys are dealt, of so many listed ones among so many."""
    return max(1, -(-int((listed + MISTAKEN * every) * BITS_PER_KEY) // (8 * MOST_BYTES)))


def listed_by(levels: list[Level], key: Column) -> Column:
    """Exact membership of a key of the universe."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].holds(key, i), F.lit(i % 2 == 1)).otherwise(out)
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``pages`` needs page_id and url; other columns are ignored. ``listed`` has one column, key: hosts
    to block; null or repeated ones count once or not at all, and hosts that no page has don't matter.
    The longest fitting rule decides; else the cascade over all hosts of ``pages``. Null urls and urls
    without :// have empty host and path, fit no rule, and are allowed unless the empty host is listed.
    Repeated rows are all judged; an empty table gives no rows.
    """
    spark = pages.sparkSession
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe, universe_at = scratch.keep(split.select(F.col("host").alias("key")).distinct())
    inside, inside_at = scratch.keep(universe.join(listed.select("key").distinct(), "key", "left_semi"))
    parts = parts_of(inside.count(), universe.count())
    if parts == 1:
        judged = _judged(split, rules, build_cascade(inside, universe))
    else:
        # each part is a folder, so that judging it reads no other
        at = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts)).cast("int").alias("part")
        tables = [scratch.keep(df.select("*", at(key)), "part") for df, key in ((split, "host"), (universe, "key"), (inside, "key"))]
        judged = None
        for p in range(parts):
            own, every, some = (df.where(F.col("part") == p).drop("part") for df, _ in tables)
            one = _judged(own, rules, build_cascade(some, every))
            judged = one if judged is None else judged.union(one)
        for _, path in tables[1:]:
            scratch.drop(spark, path)
    for path in (universe_at, inside_at):
        scratch.drop(spark, path)
    return judged


def _judged(split: DataFrame, rules: list[Rule], levels: list[Level]) -> DataFrame:
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    actions = F.lit("block")
    for r in rules:
        actions = F.when(F.col("rule") == r.text, F.lit(r.action)).otherwise(actions)
    verdict = F.when(F.col("rule").isNotNull(), actions).when(listed_by(levels, F.col("host")), F.lit("block")).otherwise(F.lit("allow"))
    return split.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
