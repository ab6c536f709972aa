"""The registered queries of this package: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexifold.llm import chat, cover_tree, crf, golay, mixing, periodic, pieces, planes, ring, secret_scan, toxicity, url_models, whitening
from lexifold.sources.scratch import materialize, new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts are full of control strings; digests are read back from the output."""
    trap = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(turns)
    whole = out.withColumn("formatted", chat.formatted(F.col("segments")))
    lines = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = whole.withColumn("lines", lines).withColumn("loss", chat.loss_text(F.col("segments")))
    return read.select(
        "conv_id",
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid", "first_bad_turn",
    )


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as ids in bit-plane files, and back from the files."""
    path = new_folder(spark, "planes")
    planes.write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"), end_id=2)
    return planes.read_checksums(spark, path)


# Which domain a source belongs to, and the weights of the tree.
DOMAIN_SQL = "case when source = 'src0' then 'web' when source in ('src1', 'src2', 'src3', 'src4', 'src5') then 'books' else 'forum' end"
MIXTURE = mixing.Mixture(
    percent=60,
    weights={"web": 3, "books": 5, "forum": 2, "*/en": 4, "*/de": 2, "*/fr": 3, "*/es": 1, "books/en/src1": 3, "forum/*/src12": 0},
    max_epochs=3,
)


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: sixty percent of their words, up to three epochs of a source."""
    documents = table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN_SQL))
    words = documents.select("doc_id", "domain", "lang", "source", mixing.n_words(F.col("text")).alias("words"))
    words = materialize(words, "words")  # the texts are read once
    return mixing.mix(words, MIXTURE, F.col("words")).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def op4_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All urls, judged by the rules and, where none fits, by the models of accepted and rejected urls."""
    return url_models.judge(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and the components of those at 2 or fewer bits."""
    return golay.near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts by a machine that never saw the labels of the held-out rows."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    documents = table(spark, sf_dir, "documents")
    machine = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    scored = toxicity.score(documents, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base numbers and verdict of all texts by a field trained on labelled documents."""
    documents = table(spark, sf_dir, "documents")
    return crf.judge(documents, crf.fit(documents, table(spark, sf_dir, "labels")))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampled segmentation of every text, and whether decoding it gives the text back."""
    model = tokenizer_file("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model, keep=("text",))
    decoded = pieces.decode(encoded, model, keep=("text", "ids"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all texts, each different text scanned once and noted in a ledger."""
    folder = new_folder(spark, "ledger")
    versions = secret_scan.versions(table(spark, sf_dir, "documents"))
    secret_scan.scan(versions, folder)
    kinds = [r.kind for r in secret_scan.BASE_RULES]
    found = secret_scan.findings(versions, folder)

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds]
    base = of(*kinds)
    return found.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(secret_scan.describe(base), 256).alias("base_sha256"),
        secret_scan.describe(F.col("spans")).alias("spans"),
    )


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a cosine of 0.98 and components of all vectors, by label."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of a ring; capacities without slack, so counts differ by one at most."""
    octets = F.coalesce(F.encode("text", "UTF-8"), F.lit("").cast("binary"))
    sizes = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(octets) + 1).cast("long").alias("size"), F.crc32(octets).alias("text_crc32")
    )
    return ring.place(sizes, "doc_id", ring.Ring(shards=8)).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def white_components(vectors: DataFrame) -> DataFrame:
    """A row for each vector and component: the whitened value, and what holds for the vector, the component or all."""
    white = whitening.fit(vectors, "vec_id", "embedding")
    explained = F.array(*[F.lit(float(v / white.trace)) for v in white.values]).cast("array<double>")
    return whitening.transform(white).select(
        F.col("key").alias("vec_id"), F.lit(white.n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(whitening.identity_error(white)).alias("identity_error"),
    )


def op12_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors along the 32 leading components of their covariance."""
    return white_components(table(spark, sf_dir, "embeddings"))


def planted_cycles(documents: DataFrame) -> DataFrame:
    """``doc_id, text``: of one document in ten (by a checksum of its id) the words from some place on are made periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def cycled(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        places = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, i)), " "))

    # The words are the one element of an array, so that they are made once and not for each of them.
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), cycled), F.lit(0))).otherwise(F.col("text"))
    return documents.select("doc_id", text.alias("text"))


def cyclic_runs(documents: DataFrame) -> DataFrame:
    """Digests of the runs and of the collapsed words of ``documents`` with planted cycles."""
    found = periodic.periodic_runs(planted_cycles(documents))
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), F.lit(0))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda t: F.concat(t, F.lit("\n"))), "")
    length, period = -best["l"], best["p"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["s"].alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_maximal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, with cycles planted in every tenth."""
    return cyclic_runs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_bit_planes": op2_bit_planes,
    "op3_mixture": op3_mixture,
    "op4_url_models": op4_url_models,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_line_field": op7_line_field,
    "op8_sampled_pieces": op8_sampled_pieces,
    "op9_blob_ledger": op9_blob_ledger,
    "op10_cover_tree": op10_cover_tree,
    "op11_bounded_ring": op11_bounded_ring,
    "op12_chebyshev_whitening": op12_chebyshev_whitening,
    "op13_maximal_pairs": op13_maximal_pairs,
}
