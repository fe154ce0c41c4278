"""The registered queries of this package, each on the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import centroids, chat, exact, idfile, mixer, mixing, near, pieces, pii, quality, ranked, secrets, sharding


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.segments(chat.pairs_of_neighbours(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1's pairs, a row each, their masks written start:end."""
    df = chat.assembled(op1_chat_preferences(spark, sf_dir))
    written = lambda mask: F.array_join(F.transform(mask, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(mask)
    return df.select("pair_id", "prompt", *chat.SIDES, *[written(f"{s}_mask") for s in chat.SIDES])


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8's policies: what each rejects, and by which rule alone."""
    return quality.ablations(quality.ledger(documents(spark, sf_dir)))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(documents(spark, sf_dir))


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.round_trip(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(documents(spark, sf_dir))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sharding.sharded(documents(spark, sf_dir))
    return df.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(documents(spark, sf_dir))
    return book.select("doc_id", *quality.MEASURES, (~quality.verdict("failed_rules", "base-1")).alias("base_failed"), quality.verdict("failed_rules").alias("kept"), "failed_rules")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir), company=None)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranking(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_mixing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixer.scored(documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_preferences": op1_chat_preferences,
    "op2_secrets": op2_secrets,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_id_files": op5_id_files,
    "op6_ngram_join": op6_ngram_join,
    "op7_sharding": op7_sharding,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_personal_data": op10_personal_data,
    "op11_ranked_search": op11_ranked_search,
    "op12_mixing_scores": op12_mixing_scores,
    "op13_centroids": op13_centroids,
    "preference_pairs": preference_pairs,
    "rule_ablations": rule_ablations,
}



def _centroid_sql(rounds: int = centroids.ROUNDS) -> str:
    """A common table for each round of assignment and of means."""
    nearest = """a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS nth FROM
        (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r})) WHERE nth = 1)"""
    means = """m{n} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i) GROUP BY k),
        c{n} AS MATERIALIZED (SELECT k, coalesce(m{n}.c, c{r}.c)::BIGINT[] AS c FROM c{r} LEFT JOIN m{n} USING (k))"""
    steps = [text for r in range(rounds) for text in (nearest.format(r=r), means.format(r=r, n=r + 1))]
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h LIMIT 8)),
        {", ".join(steps)}, {nearest.format(r=rounds)}
        SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} USING (k)
    """


_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op1_chat_preferences": """
        WITH rows AS (
            SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM conversations
            UNION ALL SELECT conv_id, 'rejected', turn, role, text FROM conversations WHERE turn < 1 + conv_id % 4
            UNION ALL SELECT xor(conv_id, 1), 'rejected', turn, role, text FROM conversations WHERE turn >= 1 + xor(conv_id, 1) % 4),
        p AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) - 1 AS place FROM rows),
        n AS (SELECT pair_id, coalesce(min(place) FILTER (c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text), max(place) + 1) AS n_prompt
              FROM (SELECT * FROM p WHERE side = 'chosen') c FULL JOIN (SELECT * FROM p WHERE side = 'rejected') r USING (pair_id, place) GROUP BY pair_id),
        s AS (SELECT pair_id, CASE WHEN place < n_prompt THEN 'prompt' ELSE side END AS part, place, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, place >= n_prompt AND role = 'assistant' AS trained, n_prompt
              FROM p JOIN n USING (pair_id) WHERE place >= n_prompt OR side = 'chosen'),
        e AS (SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY place) AS stop FROM s)
        SELECT pair_id, part, place::BIGINT AS place, role, rendered, (stop - length(rendered))::BIGINT AS start, stop::BIGINT AS "end", trained, n_prompt::BIGINT AS n_prompt FROM e
    """,
    "op4_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS body FROM documents),
        g AS (SELECT doc_id, sha256(body) AS text_sha256, count(*) OVER (PARTITION BY body) AS group_size,
                     first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op6_ngram_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
        g AS (SELECT words, min(doc_id) AS id, count(*) AS copies FROM w WHERE len(words) > 0 GROUP BY words),
        s AS (SELECT DISTINCT id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 4], ' ') || ' +' END AS x FROM (SELECT id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM g)),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
        c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
        l AS (SELECT a, b FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE common >= 0.8 * (na.n + nb.n - common) - 1e-9),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT id AS a, id AS b FROM g UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
        k AS (SELECT a AS id, min(b) AS class_id FROM r GROUP BY a),
        d AS (SELECT e.a AS id, count(*) AS links, sum(g.copies) AS docs FROM e JOIN g ON g.id = e.b GROUP BY e.a)
        SELECT w.doc_id, coalesce(k.class_id, w.doc_id) AS class_id, coalesce(g.copies - 1 + coalesce(d.docs, 0), 0)::BIGINT AS n_links, coalesce(d.links, 0)::BIGINT AS n_text_links
        FROM w LEFT JOIN g ON g.words = w.words LEFT JOIN k ON k.id = g.id LEFT JOIN d ON d.id = g.id
    """,
    "op8_quality_rules": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS words, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{_WORD}')] AS lines FROM t),
        tri AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
        m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
              FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
        b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (4 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
                     + 16 * (2 * word_chars < 3 * n_words)::BIGINT + 32 * (word_chars > 30 * n_words)::BIGINT)::BIGINT AS failed_rules FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_rules & 3) <> 0 AS base_failed, failed_rules = 0 AS kept, failed_rules FROM b
    """,
    "op11_ranked_search": rf"""
        WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ranked.TERM}') AS terms FROM documents),
        d AS (SELECT doc_id, terms, len(terms) AS n FROM t WHERE len(terms) > 0),
        c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
        q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{ranked.TERM}')) AS term FROM benchmark) GROUP BY ALL),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
        s AS (SELECT doc_id, term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))) AS score FROM p JOIN f USING (term), c),
        r AS (SELECT item_id, doc_id, sum(times * score)::BIGINT AS score FROM q JOIN s USING (term) GROUP BY ALL)
        SELECT * FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0) WHERE rank <= 20
    """,
    "op13_centroids": _centroid_sql(),
}
_TURNS = ORACLE_SQL["op1_chat_preferences"].rstrip()
_LEDGER = ORACLE_SQL["op8_quality_rules"].rstrip()
_POLICY_ROWS = ", ".join(f"('{v}', '{r}', {quality.mask_of(names)}, {quality.mask_of([r])})" for v, names in quality.POLICIES.items() for r in names)

ORACLE_SQL |= {
    "preference_pairs": f"""
        WITH t AS ({_TURNS})
        SELECT pair_id, coalesce(string_agg(rendered, '' ORDER BY place) FILTER (part = 'prompt'), '') AS prompt,
               coalesce(string_agg(rendered, '' ORDER BY place) FILTER (part = 'chosen'), '') AS chosen, coalesce(string_agg(rendered, '' ORDER BY place) FILTER (part = 'rejected'), '') AS rejected,
               coalesce(string_agg(start || ':' || "end", ',' ORDER BY place) FILTER (part = 'chosen' AND trained), '') AS chosen_mask,
               coalesce(string_agg(start || ':' || "end", ',' ORDER BY place) FILTER (part = 'rejected' AND trained), '') AS rejected_mask
        FROM t GROUP BY pair_id
    """,
    "rule_ablations": f"""
        WITH l AS ({_LEDGER}), p(policy, rule, mask, bit) AS (VALUES {_POLICY_ROWS})
        SELECT policy, rule, count(*) FILTER (failed_rules & mask <> 0) AS rejected, count(*) FILTER (failed_rules & bit <> 0) AS failing, count(*) FILTER (failed_rules & mask = bit) AS only_this_rule
        FROM l, p GROUP BY policy, rule
    """,
}
