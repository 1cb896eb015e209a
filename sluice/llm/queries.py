"""The registered queries: each applies one operator, with production parameters, to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import table
from sluice.llm.registered import register


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents that are not held out."""
    from sluice.llm.langid import detect_language, held_out, train_language_model
    docs = table(spark, sf_dir, "documents")
    model = train_language_model(docs.select("doc_id", "text", "lang"), learn=~held_out())
    out = detect_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")


@register("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the component it is linked into."""
    from sluice.llm.simhash import near_duplicates
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register("op1_benchmark_decontamination", r"""
WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
     v AS (SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
     d AS (SELECT DISTINCT id, unnest(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM w WHERE len(w) > 0),
     b AS (SELECT DISTINCT id, unnest(list_transform(range(0, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM v WHERE len(w) > 0),
     n AS (SELECT id, count(*) AS n_shingles FROM b GROUP BY id),
     h AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM h JOIN n ON n.id = item_id WHERE n_shared / n_shingles >= 0.8
""")
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds at least 0.8 of a benchmark item's 5-word shingles, with the item."""
    from sluice.llm.decontam import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op5_mix_sources")
def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in a mix of the sources by the square roots of their sizes."""
    from sluice.llm.mixing import mix
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@register("op6_shard_hash_tree")
def op6_shard_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight, its slot there, and its shard when a ninth is added."""
    from sluice.llm.sharding import shard, topology
    docs = table(spark, sf_dir, "documents")
    return shard(docs.select("doc_id", "text"), topology(8), grown=topology(9), carry=["doc_id"])


URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
_RULES_SQL = ", ".join(f"('{r}', '{a}')" for r, a in URL_RULES)


@register("op7_url_filter_cascade", rf"""
WITH u AS (SELECT page_id, regexp_replace(url, '^.*?://', '', 's') AS rest, coalesce(contains(url, '://'), false) AS ok FROM pages),
     v AS (SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                  CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
     r AS (SELECT *, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {_RULES_SQL}) t(rule, action)),
     m AS (SELECT v.*, (SELECT max_by((r.rule, r.action), (length(r.rule), length(r.h))) FROM r
                        WHERE (v.host = r.h OR ends_with(v.host, '.' || r.h)) AND starts_with(v.path, r.p)) AS best FROM v)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], 'allow') AS verdict FROM m
""")
def op7_url_filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, deciding rule and verdict, by cascades over all keys of the pages' URLs."""
    from sluice.llm.urlfilter import judge_urls
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@register("op10_licence_scan")
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    from sluice.llm.licences import scan_licences
    out = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@register("op3_permutation_search")
def op3_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100."""
    from sluice.llm.permutation import search
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 100 = 0"))


@register("op2_suffix_array_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
     b AS (SELECT doc_id, unnest(h) AS byte, unnest(range(0, len(h))) AS i FROM d),
     s AS (SELECT doc_id, i, byte, CASE WHEN count(*) OVER x = 50 THEN md5(string_agg(byte, '') OVER x) END AS k FROM b
           WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
     f AS (SELECT k, min(doc_id) AS first FROM s WHERE k IS NOT NULL GROUP BY k),
     r AS (SELECT s.doc_id, s.i, byte, coalesce(f.first < s.doc_id, false) AS starts FROM s LEFT JOIN f USING (k)),
     c AS (SELECT doc_id, i, byte, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
     e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
     g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
                  sha256(unhex(coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), ''))) AS kept_sha256 FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
""")
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that a document with a smaller id has too."""
    from sluice.llm.suffix_dedup import remove_repeated_bytes
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op4_substring_dedup", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
     s AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER x AS k, count(*) OVER x AS n FROM p
           WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
     f AS (SELECT k, min({'d': doc_id, 'i': i}) AS first FROM s WHERE n = 20 GROUP BY k),
     r AS (SELECT s.doc_id, s.i, word, coalesce(n = 20 AND (first.d < s.doc_id OR first.d = s.doc_id AND first.i < s.i), false) AS starts FROM s LEFT JOIN f USING (k)),
     c AS (SELECT doc_id, i, word, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
     g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
                  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
""")
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the windows of 20 words that also start earlier."""
    from sluice.llm.substring_dedup import remove_repeated_words
    return remove_repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op13_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
                  t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 AS plain FROM u),
     p AS (SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf,
                  CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(pre) END AS prefix_chars, CASE WHEN NOT plain THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts, form, and digests of its fill-in-middle output and of the text restored from it."""
    from sluice.llm.fim import fill_in_middle, restore
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@register("op12_presence_mask_search", rf"""
WITH t AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
     s AS (SELECT count(*) AS nn, sum(len(ts))::BIGINT AS ll FROM t WHERE len(ts) > 0),
     q AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
     v AS (SELECT DISTINCT term FROM q),
     w AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS term FROM t),
     f AS (SELECT doc_id, any_value(n) AS n, term, count(*) AS tf FROM w SEMI JOIN v USING (term) GROUP BY doc_id, term),
     g AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term),
     c AS (SELECT doc_id, term, g.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))) AS score FROM f JOIN g USING (term), s),
     r AS (SELECT item_id, doc_id, sum(score)::BIGINT AS score FROM q JOIN c USING (term) GROUP BY item_id, doc_id HAVING sum(score) > 0),
     k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
""")
def op12_presence_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest-scoring documents of every benchmark item."""
    from sluice.llm.lexical import rank_documents
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op11_toxicity_grammar")
def op11_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from the labels of documents that are not held out."""
    from sluice.llm.toxicity import held_out, score_toxicity, train_toxicity_model
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity_model(docs, table(spark, sf_dir, "labels"), learn=~held_out())
    out = score_toxicity(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
