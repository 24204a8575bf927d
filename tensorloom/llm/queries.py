"""The ten operators, each applied with production parameters to its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm.chat import link_calls
from tensorloom.llm.common import shared_path, table
from tensorloom.llm.decontaminate import find_leaks
from tensorloom.llm.exact_dedup import exact_dedup
from tensorloom.llm.line_dedup import drop_boilerplate, html_text
from tensorloom.llm.mixing import mix
from tensorloom.llm.near_dedup import near_groups
from tensorloom.llm.quality import classify
from tensorloom.llm.sharding import shard_by_bytes
from tensorloom.llm.substrings import remove_repeats
from tensorloom.llm.warc import read_bundles, with_revisits, write_bundles


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without the lines that are on over a fifth of its site's pages."""
    return drop_boilerplate(table(spark, sf_dir, "pages"), html_text("html")).select("page_id", "host", "n_lines", "n_dropped", "clean_text")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written to seekable bundles and read back from them."""
    pages = with_revisits(table(spark, sf_dir, "pages"))
    records = read_bundles(write_bundles(pages, shared_path(spark, "warc")))
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in 16 contiguous shards of near equal bytes."""
    return shard_by_bytes(table(spark, sf_dir, "documents"), 16).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document, by its four-word shingles at a similarity of 0.8 or more."""
    return near_groups(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each: sources weigh 1, 2, 3, repeating."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels that are not held out."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without the 50-byte strings that documents with smaller ids have too."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The tools of op10: a turn that is not the assistant's is a call of the tool named like its role. Longer texts, and instructions
#: that aren't the first turn, break their schemas.
ASK = {"text": ("string", True, {"minLength": 1, "maxLength": 300}), "turn": ("integer", True, {"minimum": 0})}
INSTRUCT = {"text": ("string", True, {"minLength": 40, "maxLength": 200}), "turn": ("integer", True, {"minimum": 0, "maximum": 0})}


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation: other turns than the assistant's call, the assistant's answer the turn before theirs.

    A call is named conv_id:turn, depends on the call two turns earlier, and has the turn's text and number as arguments.
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = turns.where("role IS DISTINCT FROM 'assistant'").select(
        F.when(known, name(F.col("turn"))).alias("call_id"),
        F.col("turn").alias("position"),
        F.coalesce("role", F.lit("none")).alias("tool"),
        F.to_json(F.struct("turn", "text")).alias("arguments"),
        F.array(F.when(known, name(F.col("turn") - 2))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select(F.when(known, name(F.col("turn") - 1)).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    linked = link_calls(calls, results, {"user": ASK, "system": INSTRUCT})
    return linked.withColumn("problems", F.array_join("problems", "; "))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:].split("_")[0].isdigit()}


#: A-Z lower-cased and nothing else.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_exact_dedup": f"""
        WITH h AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
        g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM h)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, keep_id = doc_id AS kept, text_sha256 FROM g""",
    "op2_line_dedup": r"""
        WITH p AS (
            SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '') AS host,
                list_filter(list_transform(string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '') AS lines
            FROM pages),
        total AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
        held AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
        gone AS (SELECT host, list(line) AS common FROM held JOIN total USING (host) WHERE n >= 3 AND n > pages * 0.2 GROUP BY host),
        k AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: common IS NULL OR NOT list_contains(common, x)) AS kept FROM p LEFT JOIN gone ON p.host = gone.host)
        SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, coalesce(array_to_string(kept, chr(10)), '') AS clean_text FROM k""",
    "op3_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM g""",
    "op4_sharding": """
        WITH bits AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, CAST(i AS BIGINT)) AS v FROM range(256) r(i))),
        d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
        c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, bits),
        o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
        s AS (SELECT *, CAST(least(15, floor((CAST(before AS DOUBLE) + CAST(size AS DOUBLE) / 2) * 16 / CAST(total AS DOUBLE))) AS INTEGER) AS shard FROM o)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""",
    "op5_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_sort(list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
            FROM w),
        c AS (SELECT shingles, min(doc_id) AS id, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
        e AS (SELECT id, n, unnest(shingles) AS shingle FROM c),
        links AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.shingle = y.shingle AND x.id < y.id GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (SELECT id AS node, id AS low FROM c UNION SELECT l.b, r.low FROM reached r JOIN both_ways l ON l.a = r.node),
        label AS (SELECT node, min(low) AS low FROM reached GROUP BY node)
        SELECT doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(label.low, doc_id) AS component_id, coalesce(label.low, doc_id) = doc_id AS kept
        FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN label ON label.node = c.id""",
    "op10_chat": """
        WITH c AS (SELECT conv_id || ':' || turn AS call_id, conv_id, turn, role, text FROM conversations WHERE role <> 'assistant'),
        steps AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM (SELECT DISTINCT call_id, conv_id, turn FROM c)),
        l AS (SELECT call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM steps),
        r AS (SELECT conv_id || ':' || (turn - 1) AS id, min(struct_pack(turn := turn, text := text)) AS r, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1),
        o AS (
            SELECT coalesce(c.call_id, r.id) AS call_id, c.turn AS position, c.role AS tool, CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'pending' ELSE 'linked' END AS status,
                l.level, coalesce(r.n, 0) AS n_results, r.r.turn AS result_position,
                CASE WHEN c.call_id IS NOT NULL THEN list_sort(list_filter(CASE role
                    WHEN 'user' THEN [CASE WHEN c.text IS NULL THEN 'missing text' WHEN length(c.text) < 1 THEN 'shorter than 1: text' WHEN length(c.text) > 300 THEN 'longer than 300: text' END, CASE WHEN c.turn < 0 THEN 'below 0: turn' END]
                    WHEN 'system' THEN [CASE WHEN c.text IS NULL THEN 'missing text' WHEN length(c.text) < 40 THEN 'shorter than 40: text' WHEN length(c.text) > 200 THEN 'longer than 200: text' END, CASE WHEN c.turn < 0 THEN 'below 0: turn' WHEN c.turn > 0 THEN 'above 0: turn' END]
                    ELSE ['unknown tool'] END, lambda x: x IS NOT NULL)) END AS found, c.text, r.r.text AS answer
            FROM c LEFT JOIN l ON c.call_id = l.call_id FULL JOIN r ON c.call_id = r.id)
        SELECT call_id, position, tool, status, level, CAST(n_results AS BIGINT) AS n_results, result_position, len(found) = 0 AS valid, array_to_string(found, '; ') AS problems,
            '{"arguments":' || CASE WHEN status = 'orphan' THEN 'null' ELSE '{' || CASE WHEN text IS NULL THEN '' ELSE '"text":' || CAST(to_json(text) AS VARCHAR) || ',' END || '"turn":' || position || '}' END
            || ',"id":' || CAST(to_json(call_id) AS VARCHAR) || ',"level":' || coalesce(CAST(level AS VARCHAR), 'null')
            || ',"problems":' || coalesce(CAST(to_json(found) AS VARCHAR), 'null')
            || ',"result":' || coalesce(CAST(to_json(answer) AS VARCHAR), 'null') || ',"status":"' || status || '","tool":' || coalesce('"' || tool || '"', 'null') || '}' AS json
        FROM o""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
