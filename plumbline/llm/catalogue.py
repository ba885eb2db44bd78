"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.decontamination import find_contaminated
from plumbline.llm.embeddings import near_vectors
from plumbline.llm.language import fit_language, predict_language
from plumbline.llm.packing import pack_documents
from plumbline.llm.pages import main_texts
from plumbline.llm.periodic import find_runs, run_digests, with_cycles
from plumbline.llm.pii import find_pii, pii_digests
from plumbline.llm.repeats import find_repeats, remove_repeats
from plumbline.llm.secrets import scan_secrets, secret_digests
from plumbline.llm.simhash import near_duplicates
from plumbline.llm.tokens import token_counts
from plumbline.llm.toxicity import fit_toxicity, labelled_texts, score_toxicity
from plumbline.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def fold(modulus: int):
    """crc32 of the document's id as text, modulo ``modulus``."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


@query("op1_toxicity")
def op1(spark: SparkSession, root: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled documents of four folds in five."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    labels = table(spark, root, "labels").where(fold(5) != 0).select("doc_id", "toxic")
    model = fit_toxicity(labelled_texts(docs, labels))
    found = score_toxicity(docs, model)
    held_out = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP2_SQL = """
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(5, len(w)) AS k FROM items WHERE len(w) > 0),
wanted AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
           FROM (SELECT item_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM sized)),
words AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
cut AS (SELECT doc_id, r, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i
        FROM words, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k),
held AS (SELECT DISTINCT doc_id, r, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM cut),
shared AS (SELECT doc_id, r, item_id, count(*) AS n_shared FROM held JOIN wanted USING (k, s) GROUP BY doc_id, r, item_id),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY item_id)
SELECT doc_id, item_id, n_shared, n_shingles, CAST(n_shared AS DOUBLE) / n_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE n_shared >= 0.8 * n_shingles
"""


@query("op2_decontamination", OP2_SQL)
def op2(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    return find_contaminated(table(spark, root, "documents").select("doc_id", "text"), table(spark, root, "benchmark"))


@query("op3_repeats")
def op3(spark: SparkSession, root: str) -> DataFrame:
    """All documents without the bytes of 400-byte strings that begin more than once."""
    return remove_repeats(find_repeats(table(spark, root, "documents")))


@query("op4_packing")
def op4(spark: SparkSession, root: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, root, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_token_counts")
def op5(spark: SparkSession, root: str) -> DataFrame:
    """Token counts of all documents. The cache begins empty, so that the query's cost is that of the whole work."""
    counts = token_counts(table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query("op6_pii")
def op6(spark: SparkSession, root: str) -> DataFrame:
    """Personal data in all documents."""
    return pii_digests(find_pii(table(spark, root, "documents")))


@query("op7_embeddings")
def op7(spark: SparkSession, root: str) -> DataFrame:
    """Links and components of all embeddings of one label at a cosine of 0.93."""
    return near_vectors(table(spark, root, "embeddings"))


@query("op8_simhash")
def op8(spark: SparkSession, root: str) -> DataFrame:
    """Fingerprints of all documents and the components they form at two or fewer differing bits."""
    found = near_duplicates(table(spark, root, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_language")
def op9(spark: SparkSession, root: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    docs = table(spark, root, "documents")
    model = fit_language(docs.where(fold(3) != 1))
    return predict_language(docs, model).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op10_secrets")
def op10(spark: SparkSession, root: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_digests(scan_secrets(table(spark, root, "documents")))


@query("op11_periodic_runs")
def op11(spark: SparkSession, root: str) -> DataFrame:
    """Periodic runs of words in all documents, of which one in ten has a tail that repeats itself."""
    return run_digests(find_runs(with_cycles(table(spark, root, "documents"))))


@query("op12_main_text")
def op12(spark: SparkSession, root: str) -> DataFrame:
    """Main text of all pages, by wrappers inferred for each host from all of its pages."""
    return main_texts(table(spark, root, "pages"))


@query("op13_whitening")
def op13(spark: SparkSession, root: str) -> DataFrame:
    """All usable embeddings along the eight axes of greatest variance."""
    return whiten(table(spark, root, "embeddings"))
