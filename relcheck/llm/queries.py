"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, bm25, chat, decontam, html_text, lang_id, packing, quality, ranked, simhash, suffix_dedup, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_id.identify(docs, lang_id.learn(docs))
    return found.select("doc_id", lang_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic")
    return toxicity.score(docs, toxicity.learn(docs, labels))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a conversation of its own whose texts are made of control strings
    odd = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd)
    return chat.digests(chat.read_back(chat.render(chat.fold(chat.events_of(turns)))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_url_filter, op3_suffix_dedup, op4_topk_search, op5_toxicity, op6_html_text, op7_decontamination, op8_quality, op9_simhash, op10_packing, op11_chat_format, op12_filter_audit, op13_ranked_search)
}

ORACLE: dict[str, str] = {
    "op2_url_filter": r"""
        WITH u AS (
            SELECT row_number() OVER () AS r, page_id,
                translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
        SELECT u.page_id, any_value(host) AS host, any_value(path) AS path, arg_max(h || p, length(h || p)) AS rule, coalesce(arg_max(v, length(h || p)), 'allow') AS verdict
        FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        GROUP BY u.r, u.page_id""",
    "op7_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS s
            FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) t(p) WHERE len(w) > 0),
        pos AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
            FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) t(p)),
        occ AS (SELECT doc_id, p, pos.n, item_id FROM pos JOIN win ON pos.s = win.s AND pos.n = win.n),
        hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM occ, unnest(range(p, p + n)) t(q) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM occ GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op11_chat_format": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
        sized AS (SELECT *, role || chr(10) || text || chr(10) AS said FROM c),
        counted AS (SELECT *, 2 * length(said) - 2 - length(replace(said, '\\', '')) + 20 + list_sum([(length(said) - length(replace(said, s, ''))) // length(s) FOR s IN ['<s>', '</s>', '[INST]', '[/INST]']]) AS chars FROM sized)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM counted GROUP BY conv_id""",
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        m AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
        f AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS bad,
                EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id AND toxic = 1) AS toxic
            FROM t JOIN m USING (text)),
        l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(substr(filter_order, step, 1)) - 64 AS filter FROM o, unnest(range(1, 6)) u(step)),
        r AS (SELECT part, good, toxic, bad, filter_order, (SELECT min(strpos(filter_order, x)) FROM l WHERE bad[ascii(x) - 64]) AS gone FROM f, o),
        p AS (SELECT part, s.filter_order, s.step, s.filter, count(*) FILTER (WHERE coalesce(gone > s.step, true)) AS kept, count(*) FILTER (WHERE gone = s.step) AS removed,
                count(*) FILTER (WHERE gone < s.step AND bad[s.filter]) AS redundant, count(*) FILTER (WHERE bad[s.filter] AND len([y FOR y IN bad IF y]) = 1) AS unique_fails,
                count(*) FILTER (WHERE gone = s.step AND good) AS good_lost, count(*) FILTER (WHERE gone = s.step AND toxic) AS toxic_lost
            FROM r JOIN s ON r.filter_order = s.filter_order GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM p""",
    "op13_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM benchmark),
        g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
        p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL),
        df AS (SELECT t, count(*) AS df FROM p WHERE t IN (SELECT t FROM b) GROUP BY t),
        w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, g),
        c AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms))))) AS BIGINT) AS score
            FROM b JOIN w USING (t) JOIN p USING (t), g GROUP BY ALL),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM c WHERE score > 0)
        SELECT * FROM k WHERE rank <= 50""",
}
