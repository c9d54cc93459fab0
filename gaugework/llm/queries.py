"""The numbered queries: each applies its operator to a whole table and returns the rows its contract names."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugework.llm import (
    bpe, decontaminate, exact_dedup, html_text, jaccard_join, licenses, manifest, mixing, quality, sharding, toxicity, variants,
    warc,
)
from gaugework.llm.registry import query
from gaugework.sources.tables import load

MIX_WEIGHTS = [5, 2, 1]


@query(
    "op1_mixing",
    """
    WITH base AS (
        SELECT doc_id, source,
            CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
            ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS position
        FROM documents),
    sums AS (
        SELECT source, sum(size)::BIGINT AS source_size,
            [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
        FROM base GROUP BY source),
    total AS (SELECT 1.5 * sum(source_size)::DOUBLE AS words FROM sums),
    filling AS (
        SELECT sums.*, words,
            coalesce(sum(2.0 * source_size::DOUBLE) OVER (ORDER BY 2.0 * source_size::DOUBLE / weight, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS given,
            sum(weight) OVER (ORDER BY 2.0 * source_size::DOUBLE / weight, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
        FROM sums, total),
    marked AS (SELECT *, 2.0 * source_size::DOUBLE * weights < weight * (words - given) AS clamped FROM filling),
    rest AS (
        SELECT max(words) - coalesce(sum(2.0 * source_size::DOUBLE) FILTER (WHERE clamped), 0) AS words,
            coalesce(sum(weight) FILTER (WHERE NOT clamped), 0)::DOUBLE AS weights
        FROM marked),
    targets AS (
        SELECT source, source_size,
            CASE WHEN clamped THEN 2.0 * source_size::DOUBLE ELSE weight * rest.words / rest.weights END AS target
        FROM marked, rest),
    parts AS (
        SELECT *, least(floor(target / greatest(source_size, 1)), 2)::BIGINT AS whole FROM targets),
    ordered AS (
        SELECT doc_id, size, source_size, target, whole,
            greatest(floor(target)::BIGINT - whole * source_size - coalesce(sum(size) OVER (
                PARTITION BY base.source ORDER BY position, doc_id NULLS FIRST, size
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT, 0) AS room
        FROM base JOIN parts ON base.source IS NOT DISTINCT FROM parts.source)
    SELECT doc_id, size, source_size, target, (whole * size + least(room, size))::BIGINT AS taken FROM ordered
    """,
)
def op1_mixing(spark, folder):
    plan = mixing.plan_mix(load(spark, folder, "documents"), MIX_WEIGHTS, share=1.5, epochs=2)
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op2_sharding")
def op2_sharding(spark, folder):
    placed = sharding.shard_documents(load(spark, folder, "documents"), shards=24)
    none = F.lit(None).cast("int")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard")
    )


LIMITS = {rule.name: rule for rule in quality.RULES}
STOP_LIST = ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words}))


@query(
    "op3_quality_rules",
    f"""
    WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    split AS (
        SELECT rid, doc_id, t, [w FOR w IN regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') IF w <> ''] AS words,
            [l FOR l IN string_split(t, chr(10)) IF regexp_matches(l, '[^\\x20\\x09-\\x0D]')] AS lines
        FROM base),
    windows AS (
        SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS gram
        FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split)),
    repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
    covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM (SELECT rid, i, unnest(range(5)) AS k FROM repeated) GROUP BY rid),
    counted AS (
        SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
            (length(t) - length(translate(t, '{quality.SYMBOLS}', '')))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
            coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
            len([w FOR w IN words IF lower(w) IN ({STOP_LIST})]) AS n_stop
        FROM split LEFT JOIN covered USING (rid)),
    judged AS (
        SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
            n_words >= 10 AND (word_chars / n_words < 1.5 OR word_chars / n_words > 25 OR n_symbols / n_words > {LIMITS['symbols'].high}
                OR (n_words >= 100 AND n_stop / n_words < 0.002)
                OR coalesce(n_dup_lines / nullif(n_lines, 0), 0) > 0.7) AS rule_failed
        FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
        NOT base_failed AND NOT rule_failed AS kept
    FROM judged
    """,
)
def op3_quality_rules(spark, folder):
    judged = quality.judge(load(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query(
    "op5_exact_dedup",
    """
    WITH keyed AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    grouped AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size, sha256(body) AS text_sha256 FROM keyed GROUP BY body)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM keyed JOIN grouped USING (body)
    """,
)
def op5_exact_dedup(spark, folder):
    return exact_dedup.find_copies(load(spark, folder, "documents"))


@query("op8_bpe")
def op8_bpe(spark, folder):
    import public_tokenizers

    docs = load(spark, folder, "documents")
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op7_warc")
def op7_warc(spark, folder):
    index, archives = warc.archive_pages(load(spark, folder, "pages"), least_bytes=0)
    return warc.read_archives(index, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op4_jaccard_join")
def op4_jaccard_join(spark, folder):
    found = jaccard_join.near_duplicates(load(spark, folder, "documents"), width=5, percent=75)
    return found.select("doc_id", "n_shingles", "component_id")


@query("op9_toxicity")
def op9_toxicity(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, load(spark, folder, "labels").select("doc_id", "toxic"))
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    verdict = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", verdict.alias("predicted"))


@query("op6_license_scan")
def op6_license_scan(spark, folder):
    found = licenses.scan_licenses(load(spark, folder, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


@query("op10_html_text")
def op10_html_text(spark, folder):
    pages = load(spark, folder, "pages")
    found = html_text.extract(pages, html_text.train(pages), keep=["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))


def _merkle_levels(leaf: str, levels: int) -> str:
    """Tables ``{leaf}_1 ... {leaf}_levels`` over ``{leaf}_0 (g, pos, digest)``; a group of one node stays as it is."""
    return "".join(
        f"""
    {leaf}_{k + 1} AS (
        SELECT g, pos // 16 AS pos, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
        FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {leaf}_{k}) GROUP BY g, pos // 16),"""
        for k in range(levels)
    )


def _merkle_paths(name: str, leaf: str, start: str, levels: int) -> str:
    """Tables ``{name}_1 ... {name}_levels`` over ``{start} (rid, g, pos, h, proof)``: the fold and the siblings so far."""
    tables, previous = [], start
    for k in range(levels):
        tables.append(f"""
    {name}_{k + 1} AS (
        SELECT m.rid, any_value(m.g) AS g, any_value(m.pos) // 16 AS pos,
            CASE WHEN any_value(s.n) = 1 THEN any_value(m.h)
                ELSE sha256(string_agg(CASE WHEN s.pos = m.pos THEN m.h ELSE s.digest END, '' ORDER BY s.pos)) END AS h,
            any_value(m.proof) || coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos <> m.pos), '') AS proof
        FROM {previous} m JOIN (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {leaf}_{k}) s
            ON s.g = m.g AND s.pos // 16 = m.pos // 16
        GROUP BY m.rid),""")
        previous = f"{name}_{k + 1}"
    return "".join(tables)


def _field(column: str) -> str:
    value = f"{column}::VARCHAR"
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({value}))::VARCHAR || ':' || {value} END"


#: The checksum of an ASCII text, bit by bit; 3988292384 is its reversed polynomial.
CRC32 = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, len({0}) + 1), lambda i: list_transform(range(0, 8),
                lambda k: ((ascii(({0})[i]) >> k) & 1)::BIGINT))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""
#: Levels that the SQL has: enough for 16^5 rows of a source and as many sources.
LEVELS = 5
SMALL_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_manifest",
    f"""
    WITH hashed AS (
        SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS g,
            sha256({" || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
            sha256({" || ".join(f"({_field(c)})" for c in ("doc_id", "source", "lang", "n_chars"))} || ({_field(SMALL_TEXT)})) AS small,
            coalesce({CRC32.format("doc_id::VARCHAR")} % 5 = 0, false) AS touched
        FROM documents),
    placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
    node_0 AS (SELECT g, pos, leaf AS digest FROM placed),{_merkle_levels("node", LEVELS)}
    subroots AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM node_{LEVELS}),
    top_0 AS (SELECT 'all' AS g, pos, subroot AS digest FROM subroots),{_merkle_levels("top", LEVELS)}
    start AS (SELECT rid, g, pos, CASE WHEN touched THEN small ELSE leaf END AS h, '' AS proof FROM placed),
    {_merkle_paths("path", "node", "start", LEVELS)}
    middle AS (SELECT rid, 'all' AS g, subroots.pos AS pos, h, proof FROM path_{LEVELS} p JOIN subroots ON p.g = subroots.g),
    {_merkle_paths("above", "top", "middle", LEVELS)}
    root AS (SELECT digest AS root FROM top_{LEVELS})
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
    FROM placed JOIN above_{LEVELS} a USING (rid) JOIN subroots ON placed.g = subroots.g, root
    """,
)
def op11_manifest(spark, folder):
    return manifest.merkle_manifest(load(spark, folder, "documents"), every=5)


@query(
    "op13_decontaminate",
    """
    WITH docs AS (
        SELECT row_number() OVER () AS rid, doc_id,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
    item_words AS (
        SELECT item_id::VARCHAR AS item,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark),
    windows AS (
        SELECT DISTINCT item, least(10, len(w)) AS size, array_to_string(w[i:i + 9], ' ') AS words
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM windows),
    places AS (
        SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS words
        FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
    met AS (SELECT rid, item, places.size AS size, i FROM places JOIN windows USING (size, words)),
    hit AS (
        SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS word FROM met) GROUP BY rid),
    found AS (
        SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY rid)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid)
    """,
)
def op13_decontaminate(spark, folder):
    found = decontaminate.decontaminate(load(spark, folder, "documents"), load(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


#: The checksum of a short ASCII head and a word of any letters: over UTF-8 bytes, in hexadecimal.
CRC32_BYTES = """xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(0, length(hex({0})) // 2), lambda i: list_transform(
                range(0, 8), lambda k: ((('0x' || substr(hex({0}), 2 * i + 1, 2))::BIGINT >> k) & 1)))),
                lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""


@query(
    "op12_variants",
    f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[A-Za-z\u00C0-\u00FF]+')) AS run
        FROM documents),
    counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE len(run) >= 6 GROUP BY doc_id, run),
    drawn AS (SELECT run, n, {CRC32_BYTES.format("doc_id::VARCHAR || ':' || run")} AS h FROM counted),
    words AS (
        SELECT CASE WHEN h % 199 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
        FROM drawn GROUP BY 1 HAVING len(word) >= 6 AND sum(n) >= 5),
    cut AS (
        SELECT DISTINCT word, n, len(word) AS size, k, left(word, k - 1) || substr(word, k + 1) AS less
        FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS k FROM words)),
    pairs AS (
        SELECT a.word AS a, a.n AS n, b.word AS b, b.n AS m FROM cut a JOIN cut b ON a.less = b.less AND a.k = b.k AND a.word <> b.word
        UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
        UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.less = b.word),
    best AS (
        SELECT a AS word, count(*) AS n_near, arg_min(b, (-m, b)) AS b, max(m) AS m FROM pairs GROUP BY a),
    judged AS (
        SELECT word, words.n AS n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * words.n THEN b END AS form,
            CASE WHEN m >= 5 * words.n THEN m END AS form_n
        FROM words LEFT JOIN best USING (word)),
    ways AS (
        SELECT word, word AS at FROM judged
        UNION ALL SELECT ways.word, judged.form FROM ways JOIN judged ON ways.at = judged.word WHERE judged.form IS NOT NULL),
    ends AS (SELECT ways.word, ways.at AS root FROM ways JOIN judged ON ways.at = judged.word WHERE judged.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
    """,
)
def op12_variants(spark, folder):
    return variants.spelling_variants(load(spark, folder, "documents"))
