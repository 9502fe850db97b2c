"""Corpus pipeline: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.  Between stages the rows are written as
Parquet in the shared folder and read again.

* language_id drops documents without a letter and those that the byte network
  gives no language a score of LEAST_SCORE or more.
* near_duplicates keeps the smallest document of each class of near-duplicates
  (five-word shingles, similarity of 0.8 or more); rows that repeat an id and a
  text stay or go together.
* substring_dedup cuts passages of 50 words or more that a document with a
  smaller id also has; other text stays as it is, byte for byte.
* mixing keeps the documents that the seeded token prefix of each leaf reaches,
  the one that the cut falls into included, without repetition.
* byte_bpe encodes what is left and decodes it again.

Null texts have no letter and go in the first stage; empty input passes through
every stage; columns beyond those of documents are carried along.  Decisions
are taken by id and text: rows that repeat an id with another text have their
own, and rows with a null id are kept or not like any other (copies of one text
with null ids all stay where no row with an id has it).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import ship
from marketloom.llm import bpe, langid, minhash, mixing, substrings
from marketloom.llm.arrow import written
from marketloom.llm.op1 import DOMAIN, TARGET

LEAST_SCORE = 0.4
PASSAGE = 50
MIX = mixing.Target(domains=TARGET.domains, languages=TARGET.languages, sources=TARGET.sources, share_percent=70, max_epochs=1, seed=23)


#: Columns of documents; others keep out of the operators' way under neutral names.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with other columns renamed, and their names."""
    names = {c: f"extra_{i}" for i, c in enumerate(docs.columns) if c not in OWN}
    return docs.withColumnsRenamed(names), names


def _back(rows: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _apart(docs)
    labelled = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    named = langid.identify(own, langid.train(labelled), own.columns)
    return _back(named.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs, names)


def _matching(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows whose id and mark are among `chosen`."""
    picked = chosen.select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"))
    return rows.join(picked, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _apart(docs)
    marked = own.withColumn("mark", F.xxhash64("text"))
    classes = minhash.near_duplicates(marked, width=5, percent=80, keep=("mark",))
    return _back(_matching(marked, classes.where("kept")), docs, names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _apart(docs)
    rest = [c for c in own.columns if c != "text"]
    cut = substrings.remove_repeats(own, width=PASSAGE, keep=rest, derive=substrings.spliced_of)
    changed = cut.withColumn("text", F.col("kept_text"))
    if "n_chars" in rest:
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return _back(changed, docs, names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, names = _apart(docs)
    marked = own.withColumn("mark", F.xxhash64("text"))
    chosen = mixing.mix(marked, MIX, F.expr(DOMAIN), keep=("mark",)).where("copies > 0 OR cut_tokens > 0")
    return _back(_matching(marked, chosen), docs, names)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(
        docs,
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
        derive=bpe.ids_and_digests,
        schema="n_tokens bigint, ids_sha256 string, decoded_sha256 string, token_ids array<int>",
        keep=["doc_id"],
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    return lambda spark, docs, sf_dir: stage(ship(spark), docs, sf_dir)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _shipped(language_id)),
    ("near_duplicates", _shipped(near_duplicates)),
    ("substring_dedup", _shipped(substring_dedup)),
    ("mixing", _shipped(mix_sources)),
    ("byte_bpe", _shipped(byte_bpe)),
]

#: The first stage is a trained network, which SQL cannot express; tests/llm compares the others with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
