"""The queries of this subpackage: thin readers of the tables around the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import alignment, chat_format, decontaminate, exact_dedup, fill_in_middle, html_extract, near_dedup, packing, quality, sharding, token_files, toxicity, url_filter
from .common import Scratch, prepare, table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
RULES = [url_filter.Rule(*x) for x in (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit_quality(docs, table(spark, sf_dir, "labels"), quality.remainder(F.col("doc_id"), 4) != 2)
    out = docs.select("doc_id", (quality.remainder(F.col("doc_id"), 4) == 2).alias("held_out"), quality.score_quality(F.col("text"), trees).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), 1024, 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), quality.remainder(F.col("doc_id"), 3) != 1)
    out = docs.select("doc_id", (quality.remainder(F.col("doc_id"), 3) == 1).alias("held_out"), toxicity.score_toxicity(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "tokens").path
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER), 2)
    back = token_files.read_token_files(spark, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 2, 80)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    events = chat_format.events_of(rows.unionByName(added))
    back = chat_format.read_back(chat_format.render(chat_format.fold_events(events)))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(digest, "utf-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "utf-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_benchmark_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    items = F.col("found.items")
    return out.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(items, ","), "utf-8"), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.encode("groups", "utf-8"), 256)).otherwise("")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fim_documents(table(spark, sf_dir, "documents")).select("doc_id", "fim.*")
    back = fill_in_middle.restore_text(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "utf-8"), 256).alias("output_sha256"), F.sha2(F.encode(back, "utf-8"), 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_packing, op3_toxicity, op4_token_files, op5_minhash, op6_html_extraction, op7_exact_dedup, op8_decontamination, op9_chat_format, op10_sharding, op11_url_filter, op12_alignment, op13_fill_in_middle)
}
QUERIES = {k: (lambda spark, sf_dir, f=f: (prepare(spark), f(spark, sf_dir))[1]) for k, f in QUERIES.items()}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CONTROL = r"([<\[])(\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?SYS>|<SYS>>|</SYS>>)"
_URL_PARTS = r"""u AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
             h AS (SELECT page_id, u, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
             t AS (SELECT page_id, host, path, CASE WHEN contains(u, '://') THEN host || regexp_extract(u, '(?s)^.*?://[^/?#]*(.*)$', 1) ELSE u END AS text FROM h)"""


def _rules_sql(rules: list[url_filter.Rule]) -> str:
    def fits(r: url_filter.Rule) -> str:
        return f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"

    ordered = sorted(rules, key=lambda r: -len(r.name))
    return ", ".join("CASE " + " ".join(f"WHEN {fits(r)} THEN '{x(r)}'" for r in ordered) + f" END AS {name}" for name, x in (("rule", lambda r: r.name), ("action", lambda r: r.action)))


def _order_sql(k: int) -> str:
    """Probabilities after k characters, from those after one character fewer."""
    less = "1.0::DOUBLE / 256" if k == 0 else "q.{}"
    mixed = ", ".join(f"CASE WHEN l.{x}n = 0 THEN {less.format(x)} ELSE (l.{x} + l.{x}t * {less.format(x)}) / (l.{x}n + l.{x}t) END::DOUBLE AS {x}" for x in "ar")
    return f"p{k} AS (SELECT l.s, l.c, {mixed} FROM l {f'JOIN p{k - 1} q ON q.s = l.s[2:] AND q.c = l.c' if k else ''} WHERE l.k = {k})"


_ESCAPED = rf"regexp_replace(replace({{}}, '\', '\\'), '{_CONTROL}', '\1\\\2', 'g')"

ORACLE_SQL = {
    "op5_minhash": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g
                   FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
             e AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
             r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
             c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
        SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op7_exact_dedup": f"""
        WITH g AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM g WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_decontamination": rf"""
        WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
             p AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
                   FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
             d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
             x AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k),
             h AS (SELECT x.doc_id, x.i, x.k, p.item FROM x JOIN p ON p.k = x.k AND p.g = array_to_string(x.w[x.i:x.i + x.k - 1], ' ')),
             o AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
             t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_url_filter": rf"""
        WITH {_URL_PARTS},
             j AS (SELECT *, {_rules_sql(RULES)}, md5(text)[1] < '4' AS held FROM t),
             d AS (SELECT DISTINCT text, action, held, chr(2) || text || chr(3) AS m FROM j),
             i AS (SELECT *, unnest(range(2, length(m) + 1)) AS i FROM d),
             x AS (SELECT text, action, held, m[greatest(i - 5, 1):i - 1] AS s, m[i] AS c FROM i),
             n AS (SELECT s, c, count(*) FILTER (WHERE action = 'allow' AND NOT held) AS a, count(*) FILTER (WHERE action = 'block' AND NOT held) AS r FROM x GROUP BY ALL),
             g AS (SELECT k, right(s, k) AS s, c, sum(a) AS a, sum(r) AS r FROM n, range(6) o(k) WHERE length(s) >= k GROUP BY ALL),
             l AS (SELECT *, sum(a) OVER w AS an, count(*) FILTER (WHERE a > 0) OVER w AS at, sum(r) OVER w AS rn, count(*) FILTER (WHERE r > 0) OVER w AS rt FROM g WINDOW w AS (PARTITION BY k, s)),
             {", ".join(map(_order_sql, range(6)))},
             b AS (SELECT s, c, round((ln(a) - ln(r)) * 1048576)::BIGINT AS ratio FROM (SELECT * FROM p5 {" ".join(f"UNION ALL SELECT * FROM p{k} WHERE starts_with(s, chr(2))" for k in range(5))})),
             e AS (SELECT text, action, held, sum(ratio)::DOUBLE / count(*) / 1048576 AS score FROM x JOIN b USING (s, c) GROUP BY ALL),
             f AS (SELECT greatest(least(floor(score * 64), 512), -512) AS step, action FROM e WHERE held AND action IS NOT NULL),
             v AS (SELECT z AS step, (SELECT count(*) FROM f WHERE action = 'allow' AND step < z) * (SELECT count(*) FROM f WHERE action = 'block')
                                   + (SELECT count(*) FROM f WHERE action = 'block' AND step >= z) * (SELECT count(*) FROM f WHERE action = 'allow') AS error FROM range(-512, 513) y(z)),
             w AS (SELECT step / 64 AS threshold FROM v ORDER BY error, abs(step), step LIMIT 1)
        SELECT page_id, host, path, rule, coalesce(j.action, CASE WHEN score >= threshold THEN 'allow' ELSE 'block' END) AS verdict
        FROM j JOIN e ON e.text = j.text AND e.action IS NOT DISTINCT FROM j.action, w""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
             r AS (SELECT *, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
             c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
             p AS (SELECT *, array_to_string(u[1:i], '') AS prefix, array_to_string(u[i + 1:j], '') AS middle, array_to_string(u[j + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op9_chat_format": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
             g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn) AS turns,
                          coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS loss,
                          sum(23 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS formatted_chars
                   FROM c GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""",
}
