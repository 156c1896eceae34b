"""Secret scan with corpus-wide ownership frequency.

Three base patterns mark spans in a text. Every value found, and every long run of letters and digits, is a
candidate if it looks random; its hash is counted over the whole corpus by distinct owners, distinct repositories
and distinct texts of a repository. A value that few owners, few repositories and few texts hold is ``owned``
(live-looking); one that is spread wider in any of the three is ``copied``, an example that many took over, be it
within one owner. Either label gets a span of its kind; base spans stay in either case.

Only DataFrame functions are used. Spark has no function for the places of all matches:
the text is split at the pattern, and the lengths of the pieces and the matches add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.common import cut, key_join, keyed, sha256_text, small, written

ASSIGN = (
    "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"
    "[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Long runs that may be keys of a kind that no base pattern knows.
RUN = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "owned", "copied"]

#: At most so many owners, repositories and texts (once in each repository) hold a live-looking value.
MAX_OWNERS, MAX_REPOS, MAX_TEXTS = 2, 4, 20
#: A live-looking value has so many distinct characters at least, a letter and a digit.
MIN_DISTINCT = 8

_MATCH = "array<struct<kind:int,j:int,gap:int,len:int,value:string>>"


def _matches(text: Column, kind: int, pattern: str, group: int = 0) -> Column:
    """Matches of a pattern in order: length of the text before each since the last, own length, value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(found.alias("m"), value.alias("v"), F.slice(F.split(text, pattern), 1, F.size(found)).alias("g"))
    made = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("j"),
            F.length(x["g"]).alias("gap"),
            F.length(x["m"]).alias("len"),
            x["v"].alias("value"),
        ),
    )
    return made.cast(_MATCH)


def _looks_random(v: Column) -> Column:
    return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT)


def spans_of(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """(_id, _th, owner, repo, kind, s, e, value): base spans (kinds 0-2) and runs (kind 3) of each document."""
    base = keyed(docs, id_col, text_col, owner.alias("owner"), repo.alias("repo"))
    low = F.lower("_text")
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    base = base.withColumn("_long", F.col("_text").rlike(RUN)).withColumn("_named", named)
    text, none = F.col("_text"), F.array().cast(_MATCH)
    found = base.filter(F.col("_long") | F.col("_named")).select(
        "_id",
        "_th",
        "owner",
        "repo",
        F.concat(
            F.when(F.col("_named"), _matches(text, 0, ASSIGN, 2)).otherwise(none),
            F.when(F.col("_long") & text.contains("AKIA"), _matches(text, 1, ACCESS)).otherwise(none),
            F.when(F.col("_long"), _matches(text, 2, HEX)).otherwise(none),
            F.when(F.col("_long"), _matches(text, 3, RUN)).otherwise(none),
        ).alias("found"),
    )
    # a row that is listed more than once would add its lengths twice
    found = found.filter(F.size("found") > 0).groupBy("_id", "_th", "owner", "repo").agg(F.first("found").alias("found"))
    rows = found.select("_id", "_th", "owner", "repo", F.explode("found").alias("x")).select(
        "_id", "_th", "owner", "repo", "x.*"
    )
    so_far = Window.partitionBy("_id", "_th", "owner", "repo", "kind").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(so_far)
    rows = rows.withColumn("e", end.cast("int")).withColumn("s", F.col("e") - F.col("len"))
    return rows.filter((F.col("kind") != 0) | (F.length("value") >= 6)).select(
        "_id", "_th", "owner", "repo", "kind", "s", "e", "value"
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repos, texts) over the corpus.

    Summed text by text, repository by repository and owner by owner, so a common value never meets in one task.
    """
    one = candidates.groupBy("hash", "owner", "repo", "_th").agg(F.lit(1).alias("one"))
    two = one.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("texts"))
    three = two.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("texts").alias("texts"))
    return three.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("texts").alias("texts"))


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str | None = "lang",
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
    max_texts: int = MAX_TEXTS,
) -> DataFrame:
    """One row per document row: _id, _th, n_assign, n_access, n_hex, n_owned, n_copied, base, spans, most_owners, most_repos, most_texts.

    Spans are arrays of (s, kind, e, label); the last three columns are the largest frequencies of the document's
    candidates, 0 without any. ``owner_col`` names the owner; owner and ``repo_col`` together name the repository.
    A null text is empty, a null owner or repository one of its own, null ids are equal. Repeated rows count as one
    and each get its result; an empty table has no rows. A long text is matched in one pass for each pattern.
    """
    owner = F.col(owner_col)
    repo = F.struct(F.col(owner_col), F.col(repo_col)) if repo_col else F.struct(owner)
    # hashes of names, as null is a name here
    rows = cut(
        spans_of(docs, id_col, text_col, F.xxhash64(F.struct(owner.isNull(), owner)), F.xxhash64(F.to_json(repo), owner.isNull()))
        .withColumn("hash", F.sha2("value", 256))
    )
    candidates = rows.filter(_looks_random(F.col("value")))
    narrow = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos) & (F.col("texts") <= max_texts)
    counted = small(written(ownership(candidates).withColumn("kind", F.when(narrow, 3).otherwise(4))))
    value_start = F.col("e") - F.length("value")
    judged = candidates.drop("kind").join(counted, "hash").select("_id", "_th", "kind", value_start.alias("s"), "e", "owners", "repos", "texts")
    none = [F.lit(None).cast("long").alias(c) for c in ("owners", "repos", "texts")]
    every = rows.filter("kind < 3").select("_id", "_th", "kind", "s", "e", *none).unionByName(judged).distinct()
    label = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.struct("s", "kind", "e", label.alias("label"))
    most = [F.max(c).alias(f"most_{c}") for c in ("owners", "repos", "texts")]
    per = every.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(span)).alias("spans"), *most)
    keys = keyed(docs, id_col, text_col).select("_id", "_th")
    out = key_join(keys, per, "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<s:int,kind:int,e:int,label:string>>")))
    out = out.withColumn("base", F.filter("spans", lambda x: x["kind"] < 3))

    def n(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return out.select("_id", "_th", *map(n, range(5)), "base", "spans", *[F.coalesce(f"most_{c}", F.lit(0).cast("long")).alias(f"most_{c}") for c in ("owners", "repos", "texts")])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["label"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op4_secret_ownership(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs).select(
        F.col("_id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        sha256_text(joined(F.col("base"))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        "n_owned",
        "n_copied",
        "most_owners",
        "most_repos",
        "most_texts",
    )


def _sql_kind(kind: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT rid, own, repo, txt, {kind} AS kind, unnest(range(1, len(m) + 1)) AS j, m, v, g FROM (
  SELECT rid, own, repo, txt, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v,
    string_split_regex(t, '{p}') AS g FROM t)"""


OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce('o' || source, '') AS own,
  coalesce('o' || source, '') || chr(31) || coalesce('l' || lang, '') AS repo FROM documents),
t AS (SELECT *, md5(t) AS txt FROM d),
r AS ({_sql_kind(0, ASSIGN, 2)} UNION ALL {_sql_kind(1, ACCESS, 0)} UNION ALL {_sql_kind(2, HEX, 0)} UNION ALL {_sql_kind(3, RUN, 0)}),
p AS (SELECT rid, own, repo, txt, kind, v[j] AS value, len(m[j]) AS ln,
  CAST(list_sum(list_transform(m[1:j], lambda x: len(x))) + list_sum(list_transform(g[1:j], lambda x: len(x))) AS BIGINT) AS e FROM r),
s AS (SELECT *, e - ln AS s FROM p WHERE kind <> 0 OR len(value) >= 6),
c AS (SELECT * FROM s WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND len(list_distinct(string_split(value, ''))) >= {MIN_DISTINCT}),
o AS (SELECT value, count(DISTINCT own) AS owners, count(DISTINCT repo) AS repos, count(DISTINCT repo || chr(30) || txt) AS texts FROM c GROUP BY value),
a AS (SELECT DISTINCT rid, kind, s, e, NULL::BIGINT AS owners, NULL::BIGINT AS repos, NULL::BIGINT AS texts FROM s WHERE kind < 3
  UNION SELECT DISTINCT rid, CASE WHEN owners <= {MAX_OWNERS} AND repos <= {MAX_REPOS} AND texts <= {MAX_TEXTS} THEN 3 ELSE 4 END,
    e - len(value), e, owners, repos, texts FROM c JOIN o USING (value)),
x AS (SELECT *, ['assign', 'access', 'hex', 'owned', 'copied'][kind + 1] || ':' || s || ':' || e AS w FROM a),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  count(*) FILTER (kind = 3) AS n_owned, count(*) FILTER (kind = 4) AS n_copied, max(owners) AS o, max(repos) AS r, max(texts) AS t,
  string_agg(w, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY s, kind) AS spans FROM x GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied,
  coalesce(o, 0) AS most_owners, coalesce(r, 0) AS most_repos, coalesce(g.t, 0) AS most_texts
FROM d LEFT JOIN g USING (rid)
"""
