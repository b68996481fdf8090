"""The queries of this package, each over a whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelight.llm import cap_filters, chat, divergence, hidden_markov, langid, mixing, packing, quality, simhash, spelling, topk, toxicity, url_filter
from cuelight.llm.sampling import fold
from cuelight.session import ship, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(read) if name == "documents" else read


def op1_url_filter_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have neither dates nor lists: a page's fetch time follows from its id, and three lists from the hosts."""
    pages = _table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int"))
    hosts = pages.select(url_filter.host(F.col("url")).alias("host")).where("host <> ''").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int"))

    def entry(name: str, pattern, start: str, action: str, verdict: str, when: str):
        since = F.expr(f"date_add(date'2024-01-01', {start})").alias("since")
        named = (F.lit(name).alias("list"), pattern.alias("pattern"), since, F.lit(action).alias("action"), F.lit(verdict).alias("verdict"))
        return hosts.where(when).select(*named)

    own, parent = F.col("host"), F.regexp_replace("host", r"^[^.]+\.", "")
    entries = (
        entry("spam", own, "h % 200", "add", "block", "h % 3 = 0")
        .unionByName(entry("spam", own, "h % 200 + 60", "remove", "block", "h % 3 = 0 and h % 2 = 0"))
        .unionByName(entry("spam", own, "h % 200 + 120", "add", "block", "h % 3 = 0 and h % 5 = 0"))
        .unionByName(entry("adult", parent, "h % 300", "add", "block", "h % 7 = 1"))
        .unionByName(entry("trusted", F.concat(own, F.lit("/en")), "h % 150", "add", "allow", "h % 3 = 0 and h % 4 < 2"))
        .unionByName(entry("trusted", F.concat(own, F.lit("/en")), "h % 150 + 150", "remove", "allow", "h % 3 = 0 and h % 4 = 0"))
    )
    captures = pages.select("page_id", "url", day.alias("fetched_at"))
    judged = url_filter.judge(captures, entries)
    return judged.withColumn("fetched_at", F.col("fetched_at").cast("string"))


def op2_cap_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, whatever their labels: how many are near each, and its component."""
    return cap_filters.near_duplicates(_table(spark, sf_dir, "embeddings"), least=0.9)


def op3_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, by a model of the labelled ones that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.size("toxic_spans").alias("n_toxic_sentences"),
    )


def op10_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected grade of every whole text of documents, by a model of the labelled ones; ``held_out``: crc32(doc_id as text) mod 5 is 0, which are not learned from."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    tail = F.try_element_at("tail_probability", F.lit(1))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "expected_grade", tail.alias("p_above_lowest"), F.coalesce(tail >= 0.5, F.lit(True)).alias("selected")
    )


def op4_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored messages as a log of streamed, edited and regenerated ones, folded and rendered."""
    stored = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    made = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(tricky).alias("text")
    )
    chats = chat.format_chats(chat.as_streamed(stored.unionByName(made)))
    read = chats.select(
        "conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_packing_mbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, in sequences of 2,048."""
    return packing.pack(_table(spark, sf_dir, "documents"), capacity=2048, separator=0)


def op6_language_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents, by a model of those that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return langid.score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op7_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every 50th vector with all others."""
    rows = _table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op8_mixing_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mixture takes."""
    sized = mixing.sizes(_table(spark, sf_dir, "documents"))
    taken = mixing.repetitions(sized, mixing.plan(sized, max_epochs=3, cycle=(1, 2, 3)), F.col("size"), F.col("key"))
    words = (F.col("row.size") * F.col("times")).alias("taken")
    return taken.select("row.doc_id", "row.size", "source_size", "target", words)


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, those one edit away from each, and the form that each is a variant of."""
    return spelling.variants(_table(spark, sf_dir, "documents"), least_chars=5, least_n=3, times=2)


def op12_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log-likelihood of every document, by a model of those whose id is not held out; a null id, which has no remainder, is not."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 7) == 2, F.lit(False))
    model = hidden_markov.train(docs.where(~held_out))
    scored = hidden_markov.score(docs, model, ["doc_id"])
    tokens = F.lit(model.tokens).cast("long").alias("train_tokens")
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", tokens, "base_score", "score")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far sources of a language are from one another, and the terms by which each stands out, over all documents."""
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=3, most_terms=200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter_asof": op1_url_filter_asof,
    "op2_cap_filter_dedup": op2_cap_filter_dedup,
    "op3_toxicity_mil": op3_toxicity_mil,
    "op10_quality_ordinal": op10_quality_ordinal,
    "op4_chat_events": op4_chat_events,
    "op5_packing_mbs": op5_packing_mbs,
    "op6_language_unigrams": op6_language_unigrams,
    "op7_threshold_top_k": op7_threshold_top_k,
    "op8_mixing_water_filling": op8_mixing_water_filling,
    "op9_simhash_trie": op9_simhash_trie,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hidden_markov_scores": op12_hidden_markov_scores,
    "op13_source_divergence": op13_source_divergence,
}

_VECTORS = """
        given AS (SELECT row_number() OVER () AS id, vec_id, embedding FROM embeddings),
        valid AS (
            SELECT id, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM given
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""

SQL: dict[str, str] = {
    # All pairs: for tables of some thousands of vectors, as the correctness run has them.
    "op2_cap_filter_dedup": f"""
        WITH RECURSIVE {_VECTORS},
        units AS (SELECT * FROM valid WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
        links AS (
            SELECT a.id AS a, b.id AS b FROM units a JOIN units b
              ON a.id <> b.id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reach(a, b) AS (SELECT id, id FROM given UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN given ON b = id GROUP BY a),
        counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
        FROM given JOIN least ON least.a = id LEFT JOIN counted ON counted.a = id""",
    "op7_threshold_top_k": f"""
        WITH {_VECTORS},
        whole AS (SELECT id, vec_id, list_transform(e, lambda x: floor(256 * x)) AS e FROM valid),
        scored AS (
            SELECT q.id, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM whole q JOIN whole c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        WHERE rank <= 5""",
    "op1_url_filter_asof": r"""
        WITH named AS (
            SELECT page_id, DATE '2024-01-01' + ((page_id * 7919) % 366)::INTEGER AS fetched_at,
                   regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-z:.%]+\]|[^/?#:@\[\]]+)', 1), '\.$', '') AS host,
                   list_reduce(list_transform(list_filter(string_split(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'),
                                                          lambda s: s <> ''), lambda s: [s]),
                               lambda kept, s: CASE replace(lower(s[1]), '%2e', '.') WHEN '.' THEN kept WHEN '..' THEN kept[:-2] ELSE list_concat(kept, s) END,
                               []::VARCHAR[]) AS path
            FROM pages),
        hosts AS (
            SELECT host, ('0x' || substr(md5(host), 1, 6))::INTEGER AS h
            FROM (SELECT DISTINCT host FROM named WHERE host <> '')),
        entries AS (
            SELECT 'spam' AS list, host AS pattern, h % 200 AS day, 'add' AS action, 'block' AS verdict FROM hosts WHERE h % 3 = 0
            UNION ALL SELECT 'spam', host, h % 200 + 60, 'remove', 'block' FROM hosts WHERE h % 3 = 0 AND h % 2 = 0
            UNION ALL SELECT 'spam', host, h % 200 + 120, 'add', 'block' FROM hosts WHERE h % 3 = 0 AND h % 5 = 0
            UNION ALL SELECT DISTINCT 'adult', regexp_replace(host, '^[^.]+\.', ''), h % 300, 'add', 'block' FROM hosts WHERE h % 7 = 1
            UNION ALL SELECT 'trusted', host || '/en', h % 150, 'add', 'allow' FROM hosts WHERE h % 3 = 0 AND h % 4 < 2
            UNION ALL SELECT 'trusted', host || '/en', h % 150 + 150, 'remove', 'allow' FROM hosts WHERE h % 3 = 0 AND h % 4 = 0),
        dated AS (
            SELECT *, DATE '2024-01-01' + day::INTEGER AS since,
                   lead(DATE '2024-01-01' + day::INTEGER) OVER (PARTITION BY list, pattern ORDER BY day, action DESC) AS until
            FROM entries),
        active AS (
            SELECT n.page_id, d.list, d.pattern, d.verdict,
                   row_number() OVER (PARTITION BY n.page_id ORDER BY length(d.pattern) DESC, d.verdict, d.pattern, d.list) AS place,
                   count(*) OVER (PARTITION BY n.page_id) AS n_active
            FROM named n JOIN dated d
              ON d.action = 'add' AND d.since <= n.fetched_at AND (d.until IS NULL OR d.until > n.fetched_at)
             AND n.host <> ''
             AND (n.host = split_part(d.pattern, '/', 1)
                  OR NOT regexp_matches(n.host, '^(\[.*|[0-9]+(\.[0-9]+){3})$') AND ends_with(n.host, '.' || split_part(d.pattern, '/', 1)))
             AND (NOT contains(d.pattern, '/') OR n.path[1] = 'en'))
        SELECT n.page_id, n.fetched_at::DATE::VARCHAR AS fetched_at, coalesce(a.n_active, 0) AS n_active, coalesce(a.verdict = 'block', false) AS blocked,
               a.pattern AS rule, a.list
        FROM named n LEFT JOIN active a ON a.page_id = n.page_id AND a.place = 1""",
    "op4_chat_events": r"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        sized AS (
            SELECT *,
                   length(replace(replace(replace(replace(replace(role, '\', '\b'), '[INST]', '\i'), '[/INST]', '\j'), '</s>', '\k'), '<s>', '\l'))
                 + length(replace(replace(replace(replace(replace(text, '\', '\b'), '[INST]', '\i'), '[/INST]', '\j'), '</s>', '\k'), '<s>', '\l'))
                   AS chars
            FROM rows)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(chars + 17))::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
    "op8_mixing_water_filling": """
        WITH sized AS (
            SELECT doc_id, source,
                   coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                   ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS key
            FROM documents),
        totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        weighted AS (
            SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
        levels AS (
            SELECT *, (sum(source_size) OVER ()
                       - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM weighted WINDOW o AS (ORDER BY 3 * source_size / weight, source ASC NULLS LAST)),
        level AS (SELECT max(level) AS level FROM levels),
        targets AS (
            SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM level) * weight) AS target
            FROM weighted),
        needs AS (
            SELECT *, target - whole * source_size AS need
            FROM (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole
                  FROM targets)),
        first AS (
            SELECT s.doc_id, s.source, s.size, s.key, n.source_size, n.target, n.whole, n.need,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key) <= n.need AND n.need > 0 AS one,
                   sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key) AS through
            FROM sized s JOIN needs n ON s.source IS NOT DISTINCT FROM n.source),
        after_first AS (
            SELECT *, coalesce(max(key) FILTER (one) OVER (PARTITION BY source), -1) AS edge1,
                   need - coalesce(max(through) FILTER (one) OVER (PARTITION BY source), 0) AS rest1
            FROM first),
        second AS (
            SELECT *, key > edge1 AND size <= rest1 AND rest1 > 0 AS open2,
                   sum(CASE WHEN key > edge1 AND size <= rest1 THEN size ELSE 0 END)
                       OVER (PARTITION BY source ORDER BY key) AS through2
            FROM after_first),
        after_second AS (
            SELECT *, open2 AND through2 <= rest1 AS two,
                   greatest(edge1, coalesce(max(key) FILTER (open2 AND through2 <= rest1) OVER (PARTITION BY source), -1)) AS edge2,
                   rest1 - coalesce(max(through2) FILTER (open2 AND through2 <= rest1) OVER (PARTITION BY source), 0) AS rest2
            FROM second),
        third AS (
            SELECT *, key > edge2 AND size <= rest2 AND rest2 > 0 AS open3,
                   sum(CASE WHEN key > edge2 AND size <= rest2 THEN size ELSE 0 END)
                       OVER (PARTITION BY source ORDER BY key) AS through3
            FROM after_second),
        after_third AS (
            SELECT *, one OR two OR (open3 AND through3 <= rest2) AS more,
                   rest2 - coalesce(max(through3) FILTER (open3 AND through3 <= rest2) OVER (PARTITION BY source), 0) AS rest3
            FROM third),
        nearest AS (
            SELECT *, min({'away': abs(size - rest3), 'key': key}) FILTER (NOT more AND rest3 > 0) OVER (PARTITION BY source) AS best
            FROM after_third),
        last AS (
            SELECT *, NOT more AND key = best.key
                      AND abs(sum(CASE WHEN NOT more AND key = best.key THEN size ELSE 0 END) OVER (PARTITION BY source) - rest3) < rest3 AS four
            FROM nearest)
        SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN more OR coalesce(four, false) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM last""",
    "op11_spelling_variants": """
        WITH RECURSIVE crc AS (
            SELECT list(c ORDER BY i) AS t
            FROM (SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
        runs AS (
            SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, sum(n)::BIGINT AS n
            FROM (SELECT doc_id, run, count(*) AS n
                  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL)
            GROUP BY 1, 2),
        hexed AS (SELECT run, n, hex(coalesce(doc_id::VARCHAR, '') || ':' || run) AS x FROM runs),
        hashed AS (
            SELECT run, n, xor(list_reduce(list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT),
                                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
            FROM hexed, crc),
        words AS (
            SELECT word, sum(n)::BIGINT AS n
            FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
            WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        cuts AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.less = b.word
            UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.less = b.word),
        best AS (
            SELECT word, count(*) AS n_near, min({'n': -other_n, 'word': other}) AS first FROM near GROUP BY word),
        forms AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -first.n >= 2 * w.n THEN first.word END AS form,
                   CASE WHEN -first.n >= 2 * w.n THEN -first.n END::BIGINT AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word),
        chain(word, root, step) AS (
            SELECT word, word, 0 FROM words
            UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, form, c.root, f.n, n_near, form_n
        FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) c ON c.word = f.word""",
    "op13_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        held AS (SELECT doc, lang, source, term, count(*) AS n FROM (SELECT doc, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM held GROUP BY ALL HAVING count(*) >= 3),
        sizes AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT lang, source FROM docs),
        own AS (SELECT lang, source, term, sum(h.n)::HUGEINT AS n FROM held h SEMI JOIN kept k USING (lang, term) GROUP BY ALL),
        totals AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM groups LEFT JOIN own USING (lang, source) GROUP BY ALL),
        ps AS (
            SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000 * (coalesce(o.n, 0) + 1) // (g.n + s.v) AS p,
                   1 + 1000000000 * (k.n + 1) // (s.n + s.v) AS q
            FROM totals g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
            LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
            FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM ps WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every)
        WHERE part = 'pair' OR rank <= 200""",
}
