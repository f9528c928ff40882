"""Secret scans by corpus-wide ownership frequency, in Spark's own expressions.

Candidates are found by pattern in whole texts. Each one's hash is counted over the repositories and owners that have it:
what many owners share is a copied example, what belongs to few looks like a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismlake.llm.common import documents, kept, key_of, spread_join

#: Kind, pattern, group that holds the secret, least length of that group; in the order in which spans at one place sort.
#: The first three are the base kinds. `vendor` holds published key formats whose prefix names the issuer.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("vendor", r"(?:gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24}|xox[abprs]-[A-Za-z0-9-]{20}|AIza[A-Za-z0-9_-]{35})", 0, 24),
]
#: A secret that so many owners have is a copied example.
OWNERS = 3

_PARTS = "array<struct<rank:int,turn:int,gap:long,length:long,secret:string>>"


def _matches(text: Column, rank: int, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches, in turn: the code points since the match before, their own, and the secret's md5 (null: too short)."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def one(part: Column, turn: Column) -> Column:
        secret = F.regexp_extract(part["found"], pattern, group) if group else part["found"]
        known = F.when(F.length(secret) >= least, F.md5(secret))
        return F.struct(F.lit(rank).alias("rank"), turn.alias("turn"), F.length(part["before"]).cast("long").alias("gap"), F.length(part["found"]).cast("long").alias("length"), known.alias("secret"))

    return F.when(text.rlike(pattern), F.filter(F.transform(parts, one), lambda p: p["length"].isNotNull())).otherwise(F.array().cast(_PARTS))


def find(docs: DataFrame, repository: str = "doc_id", owner: str = "source", owners: int = OWNERS) -> DataFrame:
    """repository, owner, text_key, spans (start, rank, kind, end, secret's md5, n_owners, n_repositories, live), a row for each of docs.

    Null text: as empty; a text without a secret has null spans. A null owner or repository counts as one of its own. A
    repeated row has the same repository and owner and so adds nothing to a count. Very long texts are scanned whole; no match
    is left out, and a text's matches cost in proportion to their number: each is a row, and its place is a running sum of
    lengths. A secret that very many documents hold is joined in parts. An empty table gives an empty one. Other columns
    are neither read nor returned, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*(_matches(F.col("text"), rank, *kind[1:]) for rank, kind in enumerate(KINDS, 1)))
    read = docs.select(F.col(repository).alias("repository"), F.col(owner).alias("owner"), text.alias("text"))
    keyed = read.select("repository", "owner", F.xxhash64("text").alias("text_key"), found.alias("parts"))
    table = kept(keyed.withColumn("doc", F.concat_ws(":", F.hex("text_key"), key_of("repository"))), "secrets")
    some = table.where(F.size("parts") > 0)
    secrets = F.array_distinct(F.transform(F.filter("parts", lambda p: p["secret"].isNotNull()), lambda p: p["secret"]))
    pairs = some.select("repository", "owner", F.explode(secrets).alias("secret"))
    by_owner = pairs.groupBy("secret", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("secret", "owner").agg(F.count("*").alias("n"))
    counts = by_owner.groupBy("secret").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))

    before = Window.partitionBy("doc", "rank").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("gap") + F.col("length")).over(before), F.lit(0)) + F.col("gap")
    placed = some.select("doc", "parts").dropDuplicates(["doc"]).select("doc", F.inline("parts")).withColumn("start", start)
    spans = kept(placed.where("secret IS NOT NULL").select("doc", "rank", "start", (F.col("start") + F.col("length")).alias("end"), "secret"), "secret-spans")
    marked = spread_join(spans, counts, "secret", ["doc", "start"], spans.count())
    kind = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("rank")).alias("kind")
    span = F.struct("start", "rank", kind, "end", "secret", "n_owners", "n_repositories", (F.col("n_owners") < owners).alias("live"))
    by_doc = marked.groupBy("doc").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    # rows of equal repository and text share their spans
    full = spread_join(some.select("repository", "owner", "text_key", "doc"), by_doc, "doc", [], some.count(), "left")
    columns = ["repository", "owner", "text_key", "spans"]
    none = table.where(F.size("parts") == 0).withColumn("spans", F.lit(None).cast(full.schema["spans"].dataType))
    return full.select(columns).union(none.select(columns))


def _is(kind: str):
    return lambda span: span["kind"] == kind


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "source", "text"))
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    joined = lambda which: F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = lambda which: F.size(F.filter("spans", which)).cast("long")
    return found.withColumn("spans", spans).select(
        F.col("repository").alias("doc_id"),
        *(many(_is(k)).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "vendor")), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        many(_is("vendor")).alias("n_vendor"),
        many(lambda s: s["live"]).alias("n_live"),
        many(lambda s: ~s["live"]).alias("n_example"),
    )


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS, 1):
        ahead = "coalesce(sum(length(before) + length(found)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(before)"
        secret = f"regexp_extract(found, {quote(pattern)}, {group})"
        parts.append(f"""SELECT rid, doc_id, source, '{kind}' AS kind, {rank} AS rank, b AS s, b + length(found) AS e, md5({secret}) AS secret FROM (
            SELECT *, {ahead} AS b FROM (
                SELECT rid, doc_id, source, unnest(f) AS found, unnest(p[1:len(f)]) AS before, generate_subscripts(f, 1) AS i
                FROM (SELECT *, regexp_extract_all(text, {quote(pattern)}) AS f, string_split_regex(text, {quote(pattern)}) AS p FROM d WHERE regexp_matches(text, {quote(pattern)}))
            )
        ) WHERE length({secret}) >= {least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(parts)}),
c AS (SELECT secret, count(DISTINCT coalesce(source, chr(1))) AS n_owners FROM s GROUP BY secret),
per AS (
    SELECT rid, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS h, count(*) FILTER (kind = 'vendor') AS v,
           count(*) FILTER (n_owners < {OWNERS}) AS live, count(*) FILTER (n_owners >= {OWNERS}) AS example,
           string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (kind <> 'vendor') AS base,
           string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans
    FROM s JOIN c USING (secret) GROUP BY rid
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(v, 0) AS n_vendor, coalesce(live, 0) AS n_live, coalesce(example, 0) AS n_example
FROM d LEFT JOIN per USING (rid)
"""


OP8_SQL = _sql()
