"""Secrets in text: base patterns, and weak parts linked when complementary ones co-occur.

All on the main path is DataFrame functions; a text never leaves its partition, only the few
candidate spans are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Base patterns, fixed values, in the order that ties at one start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a maximal run of [0-9a-f], if of 32 or more

#: Weak parts: reported only beside complementary ones.
#: Runs are taken whole, however long (possessive, so that each is read a fixed number of times).
WEAK_ID = r"(?<![A-Za-z0-9])A[A-Z]{3}[A-Z0-9]{12,}+(?![A-Za-z0-9])"
WEAK_KEY = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[0-9A-Z+/]*+[a-z])[A-Za-z0-9+/]{24,}+={0,2}(?![A-Za-z0-9+/=])"
ENDPOINT = r"(?:https?|s3|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}"

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
#: How far apart, in code points, parts of one credential may stand.
SCOPE = 400


def _spans(text: Column, pattern: str, kind: str, keep) -> Column:
    """Spans (start, rank, end, kind) of all matches, left to right, that ``keep`` holds for.

    The pieces between matches come from split, the matches from regexp_extract_all; their lengths in
    code points add up to offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rank = KINDS.index(kind)
    struct = "struct<start:int,rank:int,end:int,kind:string>"
    empty = F.lit(None).cast(f"array<{struct}>")
    walked = F.aggregate(
        F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g")),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{struct}>").alias("out")),
        lambda acc, x: _advance(acc, x["m"], x["g"], rank, kind, keep),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.coalesce(empty, F.array().cast(f"array<{struct}>")))


def _advance(acc: Column, match: Column, gap: Column, rank: int, kind: str, keep) -> Column:
    start = acc["at"] + F.length(gap)
    end = start + F.length(match)
    one = F.struct(start.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))
    return F.struct(end.cast("int").alias("at"), F.when(keep(match), F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))


def _shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row (see common.row_key) and spans by kind: assigns, accesses, hexes, weak, of each whole text."""
    text = F.col("text")
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    always = lambda m: F.lit(True)
    return common.with_text(docs).select(
        "doc_id",
        common.row_key(F.col("doc_id"), text).alias("row"),
        _spans(text, ASSIGN, "assign", value).alias("assigns"),
        _spans(text, ACCESS, "access", lambda m: F.length(m) >= 16).alias("accesses"),
        _spans(text, HEX, "hex", always).alias("hexes"),
        F.concat(_spans(text, WEAK_ID, "id", always), _spans(text, WEAK_KEY, "key", always), _spans(text, ENDPOINT, "endpoint", always)).alias("weak"),
    )


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak candidates confirmed by an interval join within scopes.

    Parts: identifiers (strong access, weak id), secrets (strong assign and hex, weak key), endpoints.
    A weak id is reported if a secret starts within ``scope`` of it, a weak key if an identifier does,
    an endpoint if both do. Spans that overlap a base span are already reported. Parts are keyed by
    (row, start div scope) and one side is put into the neighbouring bins too, so that no key holds
    more than ``scope`` starts of each kind however long or frequent a text's candidates are. Returns row, added.
    """
    parts = scanned.where(F.size("weak") > 0).dropDuplicates(["row"]).select("row", F.explode(F.concat("assigns", "accesses", "hexes", "weak")).alias("s")).select("row", "s.*")
    role = F.when(F.col("kind").isin("access", "id"), "id").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    parts = parts.withColumn("role", role).withColumn("weak", F.col("rank") >= 3).withColumn("bin", F.floor(F.col("start") / scope))
    other = parts.where("role <> 'endpoint'").select(
        "row", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role"), (~F.col("weak")).alias("o_strong")
    )
    near = F.col("o_start").between(F.col("start") - scope, F.col("start") + scope)
    met = (
        parts.where("weak")
        .join(other, ["row", "bin"])
        .where(near)
        .groupBy("row", "start", "rank", "end", "kind")
        .agg(
            F.bool_or((F.col("o_role") == "id") & ((F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start")))).alias("has_id"),
            F.bool_or((F.col("o_role") == "secret") & ((F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start")))).alias("has_secret"),
            F.bool_or(F.col("o_strong") & (F.col("o_start") < F.col("end")) & (F.col("o_end") > F.col("start"))).alias("covered"),
        )
    )
    complete = F.when(F.col("kind") == "id", F.col("has_secret")).when(F.col("kind") == "key", F.col("has_id")).otherwise(F.col("has_id") & F.col("has_secret"))
    return met.where(complete & ~F.col("covered")).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("added"))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets of each whole text: doc_id, row, n_assign, n_access, n_hex, base and spans (arrays of start, rank,
    end, kind; code points, end exclusive, by start and then kind).

    Null or empty text: no spans. Every row gives one row. Linking goes by row (doc_id with text), so rows that
    repeat a doc_id or have none are scanned one by one, and equal rows agree. Spans that start together are ordered
    by kind as listed in KINDS. An empty table gives an empty table; further columns, whatever their names, are ignored.
    """
    scanned = common.materialize(scan(docs), "secrets")  # spans only: each text is scanned once
    base = F.array_sort(F.concat("assigns", "accesses", "hexes"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    spans = F.array_sort(F.concat("assigns", "accesses", "hexes", F.coalesce("added", none)))
    return scanned.join(linked(scanned, scope), "row", "left").select("doc_id", "row", F.size("assigns").cast("long").alias("n_assign"), F.size("accesses").cast("long").alias("n_access"), F.size("hexes").cast("long").alias("n_hex"), base.alias("base"), spans.alias("spans"))


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """The same rows and columns, each found span replaced by ``[kind]``; overlapping spans are merged
    under the first one's kind. Rows without spans are unchanged; as many rows come out as go in, repeated or null
    keys included; columns may have any names."""
    found = find(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), scope).where(F.size("spans") > 0).dropDuplicates(["row"])
    row, spans = common.fresh(docs, "_row"), common.fresh(docs, "_spans")
    held = found.select(F.col("row").alias(row), F.col("spans").alias(spans))
    whole = F.col(text)
    step = F.aggregate(
        F.col(spans),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))),
    )
    keyed = docs.withColumn(row, common.row_key(F.col(key).cast("long"), whole))
    return keyed.join(held, row, "left").withColumn(text, F.when(F.col(spans).isNotNull(), step).otherwise(whole)).select(*docs.columns)


def op10_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Secrets of every text of ``documents``."""
    return find(common.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))
