"""The registered queries of this package: ``opN_<name>`` applies operator N
to its whole table, ``pipeline`` runs the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.llm.common import SPACE, bound, read

QUERIES: dict = {}


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str):
    def keep(fn):
        QUERIES[name] = fn
        return fn
    return keep


@query("op1_sharding")
def op1(spark, sf_dir):
    from ledgerlens.llm.sharding import assign_shards
    out = assign_shards(read(spark, sf_dir, "documents"), n_shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op2_quality_rules")
def op2(spark, sf_dir):
    from ledgerlens.llm.quality_rules import apply_rules
    return apply_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op3_simhash_dedup")
def op3(spark, sf_dir):
    from ledgerlens.llm.simhash_dedup import near_duplicates
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, distance=2)


@query("op4_decontamination")
def op4(spark, sf_dir):
    from ledgerlens.llm.decontamination import contaminated
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    from ledgerlens.llm.lm_scoring import score_documents
    return score_documents(read(spark, sf_dir, "documents"))


@query("op6_sentencepiece")
def op6(spark, sf_dir):
    from ledgerlens.llm.sentencepiece_codec import encode_decode
    out = encode_decode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_substring_dedup")
def op7(spark, sf_dir):
    from ledgerlens.llm.substring_dedup import remove_repeats
    out = remove_repeats(read(spark, sf_dir, "documents"), window=50)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_html_extraction")
def op8(spark, sf_dir):
    from ledgerlens.llm.html_extraction import main_text
    return main_text(read(spark, sf_dir, "pages"))


@query("op9_token_counts")
def op9(spark, sf_dir):
    from ledgerlens.llm.token_counts import token_counts
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=1024)


# the contract's rules, as (verdict, host and path prefix)
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


@query("op10_url_filters")
def op10(spark, sf_dir):
    from ledgerlens.llm.url_filters import judge
    return judge(read(spark, sf_dir, "pages"), URL_RULES).drop("url")


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    from ledgerlens.llm.periodic_runs import periodic_runs
    docs = read(spark, sf_dir, "documents")
    out = periodic_runs(docs.select("doc_id", with_periodic_tail(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"], r["period"])))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("l"),
                     F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    length = -F.col("l.shorter")
    return out.select("doc_id", "n_runs", "l.start", length.alias("length"), "l.period",
                      F.floor(1000 * length / F.col("l.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_periodic_tail(key, text):
    """The contract's planted periods: for a tenth of the keys, the words from
    a place on repeat those after it."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)

    def planted(words):
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        place = bound(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.when(i < s["a"], i).otherwise(s["a"] + F.pmod(i - s["a"], s["p"]))))
        return F.array_join(F.transform(place, lambda i: F.get(words, i.cast("int"))), " ")

    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    tail = bound(words, lambda ws: F.when(F.size(ws) > 0, planted(ws)))
    return F.when(F.pmod(h, F.lit(10)) == 0, F.coalesce(tail, text)).otherwise(text)


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    from ledgerlens.llm.spelling_variants import spelling_variants
    return spelling_variants(read(spark, sf_dir, "documents"), plant=31)


@query("op13_fingerprints")
def op13(spark, sf_dir):
    from ledgerlens.llm.fingerprints import fingerprints
    return fingerprints(read(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)
