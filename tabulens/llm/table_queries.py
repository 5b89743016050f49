"""Queries of the operators on whole tables: whitening, manifest, main texts of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .main_text import main_texts
from .merkle import FAN, UPPER, prove
from .registry import query, table
from .whitening import whiten

# levels that the SQL climbs: sources of up to FAN ** 6 documents, up to FAN ** 4 sources
TREE_LEVELS, UPPER_LEVELS = 6, 4


def _manifest_sql() -> str:
    def field(column: str) -> str:
        text = f"CAST({column} AS VARCHAR)"
        return f"coalesce(strlen({text}) || ':' || {text}, '-')"

    def leaf(text: str) -> str:
        columns = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(map(field, columns)) + ")"

    def level(of: str) -> str:
        return f"""SELECT source, pos // {FAN} AS pos,
            CASE WHEN any_value(n) = 1 THEN any_value(hash)
                ELSE sha256(string_agg(hash, '' ORDER BY pos)) END AS hash,
            CAST(ceil(any_value(n) / {FAN}.0) AS BIGINT) AS n
        FROM {of} GROUP BY source, pos // {FAN}"""

    def step(way: str, of: str) -> str:
        return f"""SELECT c.rid, c.source, c.pos // {FAN} AS pos,
            CASE WHEN any_value(l.n) = 1 THEN any_value(c.fold) ELSE sha256(string_agg(
                CASE WHEN l.pos = c.pos THEN c.fold ELSE l.hash END, '' ORDER BY l.pos)) END AS fold,
            any_value(c.beside) || coalesce(string_agg(l.hash, '' ORDER BY l.pos)
                FILTER (WHERE l.pos <> c.pos), '') AS beside
        FROM {way} c JOIN {of} l
            ON c.source IS NOT DISTINCT FROM l.source AND c.pos // {FAN} = l.pos // {FAN}
        GROUP BY c.rid, c.source, c.pos"""

    parts = [
        """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(
            [i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t)""",
        """marked AS (SELECT d.*, coalesce(xor(4294967295, list_reduce(
            list_concat([4294967295], list_transform(
                string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0, false) AS altered
        FROM documents d, crc)""",
        f"""hashed AS (SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN altered THEN
            {leaf(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} END AS changed
        FROM marked)""",
        """leaves AS (SELECT *, row_number() OVER () AS rid,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY source) AS n
        FROM hashed)""",
        "l0 AS (SELECT source, pos, leaf AS hash, n FROM leaves)",
        "c0 AS (SELECT rid, source, pos, coalesce(changed, leaf) AS fold, '' AS beside FROM leaves)",
    ]
    for k in range(TREE_LEVELS):
        parts.append(f"c{k + 1} AS ({step(f'c{k}', f'l{k}')})")
        parts.append(f"l{k + 1} AS ({level(f'l{k}')})")
    parts += [
        f"""u0 AS (SELECT 0 AS source, source AS own, hash,
            row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
        FROM l{TREE_LEVELS})""",
        f"""w0 AS (SELECT c.rid, 0 AS source, u.pos, c.fold, c.beside
        FROM c{TREE_LEVELS} c JOIN u0 u ON c.source IS NOT DISTINCT FROM u.own)""",
    ]
    for k in range(UPPER_LEVELS):
        parts.append(f"w{k + 1} AS ({step(f'w{k}', f'u{k}')})")
        parts.append(f"u{k + 1} AS ({level(f'u{k}')})")
    joined = ",\n    ".join(parts)
    return f"""WITH {joined}
    SELECT d.doc_id, d.leaf, s.hash AS subroot, r.hash AS root, sha256(w.beside) AS proof_sha256,
        w.fold AS folded_root, w.fold = r.hash AS verified
    FROM leaves d JOIN w{UPPER_LEVELS} w ON d.rid = w.rid
        JOIN u0 s ON d.source IS NOT DISTINCT FROM s.own, u{UPPER_LEVELS} r"""


@query("op12_merkle_manifest", _manifest_sql())
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and whether it still folds to the root after the trial change."""
    return prove(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector along the eight largest principal components of all of them, whitened."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op13_html_extraction")
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, by the paths that the pages of its host agree on."""
    return main_texts(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
