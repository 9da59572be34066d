"""The operators as queries over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelwork.llm import (
    centroids, exact_dedup, language, license_scan, merkle, mixing, packing, pii, quality, simhash, token_files, vectors, winnowing,
)
from gavelwork.llm.common import documents, fold
from gavelwork.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Key of the queries; a deployment gives its own secret to ``pii.pseudonymise``.
PSEUDONYM_KEY = b"key of the registered query only."


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(quality.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    rows = docs.select("doc_id", (fold("doc_id", quality.FOLDS) == 0).alias("held_out"), quality.score_of(spark, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


@query("op4_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


@query("op5_near_vectors")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_files.write(documents(spark, sf_dir), folder, TOKENIZER)
    return token_files.read(spark, folder, with_ids=False)


@query("op7_exact_dedup", """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM n""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op8_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.train(language.training_rows(docs))
    found = docs.select("doc_id", (fold("doc_id", language.FOLDS) == language.HELD).alias("held_out"), language.labelled_of(spark, model).alias("r"))
    changes = F.greatest(F.size("r.spans") - 1, F.lit(0))
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"), changes.alias("changes"))


@query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(documents(spark, sf_dir), TOKENIZER)


def _license_sql() -> str:
    def quoted(items):
        return "[" + ", ".join("'" + i + "'" for i in items) + "]"

    rows = ", ".join(
        f"('{name}', {quoted(license_scan.template_bigrams(body))})" for name, body in license_scan.TEMPLATES
    )
    return f"""
WITH t(license, bigrams) AS (VALUES {rows}),
plain AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g') AS p FROM documents),
blocks AS (SELECT *, string_split(regexp_replace(p, '\\n[ \\n]*\\n', chr(1), 'g'), chr(1)) AS b, string_split(p, chr(10)) AS l FROM plain),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(l))) AS place, unnest(l) AS body FROM blocks
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph' AS unit, unnest(range(len(b))) AS place, unnest(b) AS body FROM blocks WHERE len(b) > 1)
    WHERE contains(body, chr(10))
  UNION ALL SELECT doc_id, 'text', 0, p FROM plain WHERE contains(p, chr(10))
),
parts AS (
  SELECT doc_id, unit, place, string_split_regex(trim(replace(body, chr(10), ' ')), ' +') AS w FROM units
),
sets AS (
  SELECT doc_id, unit, place, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS own FROM parts WHERE len(w) > 1
),
scores AS (
  SELECT doc_id, unit, place, license, 2.0::DOUBLE * len(list_intersect(own, bigrams)) / (len(own) + len(bigrams)) AS dice
  FROM sets JOIN t ON 2 * least(len(own), len(bigrams)) >= {license_scan.THRESHOLD} * (len(own) + len(bigrams))
)
SELECT doc_id, unit, CAST(place AS INTEGER) AS place, license, dice FROM scores WHERE dice >= {license_scan.THRESHOLD}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, license) = 1"""


@query("op1_license_scan", _license_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


@query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), PSEUDONYM_KEY)
    return rows.select("doc_id", "text", "pii.*")


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _manifest_sql(levels: int = 8, tops: int = 3) -> str:
    """Trees of up to 8 ** levels leaves and 8 ** tops groups, a table for each level."""
    def leaf(text: str) -> str:
        values = {n: n for n in ("doc_id", "source", "lang", "n_chars")} | {"text": text}
        parts = [f"CASE WHEN {n} IS NULL THEN '-' ELSE strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR) END" for n, v in values.items()]
        return f"sha256({' || '.join(parts)})"

    # CRC-32, a byte at a time from the decimal text of the id
    one = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    crc = f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {one}), 4294967295)"
    tables = [f"l AS (SELECT *, {leaf('text')} AS leaf, {leaf(LOWER_SQL)} AS again FROM documents)",
              "g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents))",
              f"""own AS (
  SELECT doc_id, g, leaf, CASE WHEN {crc} % 3 = 0 THEN again ELSE leaf END AS fold,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place
  FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang
)"""]
    run = f"(PARTITION BY g, place // {merkle.FANOUT} ORDER BY place ROWS BETWEEN"

    def climb(name: str, start: str, n: int) -> None:
        tables.append(f"{name}_0 AS MATERIALIZED ({start})")
        for k in range(n):
            tables.append(f"""{name}b_{k} AS MATERIALIZED (
  SELECT g, place, coalesce(string_agg(node, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(node, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a
  FROM {name}_{k} QUALIFY count(*) OVER (PARTITION BY g) > 1
)""")
            tables.append(f"""{name}_{k + 1} AS MATERIALIZED (
  SELECT g, place // {merkle.FANOUT} AS place, sha256(string_agg(node, '' ORDER BY place)) AS node FROM {name}_{k}
  WHERE g IN (SELECT g FROM {name}b_{k}) GROUP BY 1, 2
)""")
        every = " UNION ALL ".join(f"SELECT g, node, {k} AS k FROM {name}_{k}" for k in range(n + 1))
        tables.append(f"{name} AS MATERIALIZED (SELECT g, arg_max(node, k) AS node FROM ({every}) GROUP BY g)")

    climb("s", "SELECT g, place, leaf AS node FROM own", levels)
    climb("r", "SELECT 0 AS g, g AS place, node FROM s", tops)
    last = "(SELECT *, '' AS proof FROM own)"
    steps = [(f"sb_{k}", f"n.g = f.g AND n.place = f.place // {merkle.FANOUT ** k}") for k in range(levels)]
    steps += [(f"rb_{k}", f"n.place = f.g // {merkle.FANOUT ** k}") for k in range(tops)]
    for i, (beside, at) in enumerate(steps):
        tables.append(f"""f_{i} AS (
  SELECT f.doc_id, f.g, f.place, f.leaf, CASE WHEN n.b IS NULL THEN f.fold ELSE sha256(n.b || f.fold || n.a) END AS fold,
    f.proof || coalesce(n.b || n.a, '') AS proof FROM {last} f LEFT JOIN {beside} n ON {at}
)""")
        last = f"f_{i}"
    return f"""
WITH {", ".join(tables)}
SELECT doc_id, leaf, s.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.node AS verified
FROM {last} JOIN s USING (g) CROSS JOIN (SELECT node FROM r) r"""


@query("op11_merkle", _manifest_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(documents(spark, sf_dir), tampered, with_paths=False)


def _clusters_sql() -> str:
    def assigned(k: int) -> str:
        d = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"""a_{k} AS MATERIALIZED (
  SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': CAST({d} AS BIGINT), 'c': c}}) AS m FROM v CROSS JOIN c_{k} GROUP BY r
)"""

    tables = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({centroids.SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {centroids.DIMS} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
)""", f"""c_0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x AS y FROM v ORDER BY c LIMIT {centroids.CENTROIDS}
)"""]
    for k in range(centroids.ROUNDS):
        tables += [assigned(k), f"""p_{k} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS y FROM (
    SELECT m.c AS c, i, sum(x[i]) AS s, count(*) AS n FROM a_{k} CROSS JOIN range(1, {centroids.DIMS + 1}) t(i) GROUP BY 1, 2
  ) GROUP BY c
)""", f"""c_{k + 1} AS MATERIALIZED (
  SELECT c, list_transform(coalesce(p.y, o.y), lambda e: CAST(e AS BIGINT)) AS y FROM c_{k} o LEFT JOIN p_{k} p USING (c)
)"""]
    return f"""
WITH {", ".join(tables)}, {assigned(centroids.ROUNDS)}
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a_{centroids.ROUNDS} a JOIN c_{centroids.ROUNDS} c ON a.m.c = c.c"""


@query("op12_centroids", _clusters_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


@query("op13_decontamination", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER_SQL}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER_SQL}, '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(len(w), {winnowing.WINDOW}) AS n FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
h AS (
  SELECT r, s, d.n, item FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n) d
  JOIN k ON k.n = d.n AND k.g = array_to_string(d.w[s:s + d.n - 1], ' ')
),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM h)) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.drop("spans", "items")
