"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.fingerprints import fingerprints_with_next

    return fingerprints_with_next(table(spark, sf_dir, "documents"))


def fingerprint_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share a band of signatures and are similar, by verified links."""
    from tallyward.llm.fingerprints import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: Weights of the mix by domain, language and source; 1 where none is given.
MIX_WEIGHTS = ({"web": 5, "books": 3, "code": 2}, {"en": 6, "de": 2, "fr": 1, "es": 1}, {"src0": 2})
MIX = {"share": 0.6, "epochs": 4, "seed": 17}


def mixed(docs: DataFrame) -> DataFrame:
    """The mix of a documents table: its sources belong to three domains by their numbers."""
    from tallyward.llm.mixing import count_words, mix

    number = F.regexp_extract("source", "([0-9]+)$", 1)
    domain = F.when(number == "", "web").when(number.cast("decimal(38,0)") % 4 == 3, "code").when(number.cast("decimal(38,0)") % 4 == 2, "books").otherwise("web")
    return mix(docs, F.coalesce(domain, F.lit("web")), F.col("lang"), F.col("source"), MIX_WEIGHTS, count_words(F.col("text")), **MIX)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixed(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", F.col("m_domain").alias("domain"), "lang", "source", F.col("m_epoch").alias("epoch"), F.col("m_tokens").alias("tokens"))


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.bpe_codec import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.lm_score import scores

    return scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.chat_format import MarkedTemplate, format_conversations, read_back

    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    return read_back(format_conversations(rows, MarkedTemplate()), MarkedTemplate())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.toxicity import fit, held_out, toxicity_scores

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity_scores(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.topk_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def url_rules() -> list:
    from tallyward.llm.url_filter import Rule

    return [Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"), Rule("net", "/es/", "block"), Rule("net", "/fr/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), url_rules())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_fingerprints": op2_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_lm_score": op6_lm_score,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_topk_search": op9_topk_search,
    "op10_url_filter": op10_url_filter,
    "fingerprint_near_duplicates": fingerprint_near_duplicates,
}



def _mix_sql() -> str:
    """The mix in SQL: three levels of budgets, then running sums over each leaf's documents in each epoch."""
    levels = ["domain", "lang", "source"]

    def weight(k: int) -> str:
        return "CASE " + levels[k] + "".join(f" WHEN '{n}' THEN {w}" for n, w in MIX_WEIGHTS[k].items()) + " ELSE 1 END"

    parts = [f"""d AS (
            SELECT doc_id, CASE WHEN number = '' THEN 'web' WHEN CAST(number AS HUGEINT) % 4 = 3 THEN 'code' WHEN CAST(number AS HUGEINT) % 4 = 2 THEN 'books' ELSE 'web' END AS domain, lang, source, tokens, tie
            FROM (SELECT doc_id, lang, source, coalesce(regexp_extract(source, '([0-9]+)$', 1), '') AS number, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens, md5(coalesce(text, '')) AS tie FROM documents)),
        leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS supply, CAST(sum(tokens) * {MIX["epochs"]} AS BIGINT) AS cap FROM d GROUP BY ALL),
        b0 AS (SELECT 0 AS root, least(CAST(floor(sum(supply) * {int(MIX["share"] * 1000)} / 1000) AS BIGINT), sum(cap)) AS got FROM leaf)"""]  # fmt: skip
    for k, name in enumerate(levels):
        keys = ", ".join(levels[: k + 1])
        parent = ", ".join(levels[:k]) or "root"
        order = f"PARTITION BY {parent} ORDER BY cap / w, {name}"
        every = f"OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
        join = f"JOIN b{k} USING ({', '.join(levels[:k])})" if k else "CROSS JOIN b0"
        parts.append(f"""n{k} AS (SELECT {keys}{"" if k else ", root"}, w, cap, CAST(got AS HUGEINT) AS given FROM (SELECT {keys}, {weight(k)} AS w, CAST(sum(cap) AS HUGEINT) AS cap FROM leaf GROUP BY {keys}) {join}),
        r{k} AS (SELECT *, given - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM n{k}),
        l{k} AS (SELECT *, cap * share <= w * rest AS filled, first_value(CASE WHEN cap * share > w * rest THEN rest END IGNORE NULLS) {every} AS level_rest, first_value(CASE WHEN cap * share > w * rest THEN share END IGNORE NULLS) {every} AS level_share FROM r{k}),
        p{k} AS (SELECT *, CASE WHEN filled THEN cap ELSE (w * level_rest) // level_share END AS part FROM l{k}),
        b{k + 1} AS (SELECT {keys}, CAST(part + CASE WHEN NOT filled AND row_number() OVER (PARTITION BY {parent}, filled ORDER BY cap / w, {name}) <= least(given, sum(cap) OVER (PARTITION BY {parent})) - sum(part) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END AS BIGINT) AS got FROM p{k})""")  # fmt: skip
    return f"""WITH {", ".join(parts)},
        e AS (SELECT doc_id, domain, lang, source, epoch, tokens, md5(concat('{MIX["seed"]}:', epoch, ':', doc_id)) || tie AS key FROM d, range(0, {MIX["epochs"]}) AS t(epoch)),
        s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
        SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, tokens FROM s JOIN b3 USING (domain, lang, source) WHERE before < got"""


#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op3_mixing": _mix_sql(),
    "op9_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
