"""Ranked retrieval: cosine top-k, symbol rerank, weighted reciprocal-rank fusion, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from brindle.functions import text as T
from brindle.functions.joins import beside
from brindle.operators.cells import BLOCK_BYTES, CellIndex, best_pairs, has_cosine
from brindle.sources.scratch import written

K, FUSION_K, WEIGHTS = 10, 60, (1.0, 2.0)
#: Chunks and queries of one document that meet as rows in one key of search_within.
PIECE_CHUNKS, PIECE_QUERIES, PIECE_TASKS = 1024, 256, 4096


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, k: int, *tie: str) -> DataFrame:
    """The k best of each query by score, ties by the named columns; adds rank."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("score", F.col("_dot") / (F.col("q_norm") * F.col("c_norm")))


def _others(pairs: DataFrame) -> DataFrame:
    """Pairs without those of a query and the chunk that it names as its own."""
    return pairs.where(~F.col("chunk_id").eqNullSafe(F.col("own"))) if "own" in pairs.columns else pairs


def dense_search(queries: DataFrame, chunks: DataFrame, k: int = K) -> DataFrame:
    """Every query against every chunk: the k best by cosine. queries: qid, q_vec and, if a query is a chunk itself, its id as own;
    chunks: chunk_id, document_id, vec.

    A CellIndex of the chunks is written and searched; keep one where the same chunks are searched again.
    """
    return CellIndex.build(chunks).search(queries, k)


def search_within(queries: DataFrame, chunks: DataFrame, k: int = K) -> DataFrame:
    """The k best chunks of the one document each query names (queries: qid, q_vec, document_id).

    Documents with more pairs than a piece meet as blocks of vectors, of BLOCK_BYTES on either side, so that their pairs spread over tasks and never become rows; only the k
    best of a block do. Small documents, and vectors without a cosine or of another length than their document's longest, meet as rows.
    """
    of = lambda df, vec, n: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(f"_{n}"), F.min(_length(vec)).alias(f"_{n}_low"), F.max(_length(vec)).alias(f"_{n}_high"), F.count(_length(vec)).alias(f"_{n}_able"))
    sizes = of(chunks, "vec", "chunks").join(of(queries, "q_vec", "queries"), "document_id").withColumn("_large", (F.col("_chunks") * F.col("_queries") > PIECE_CHUNKS * PIECE_QUERIES) & F.col("_chunks_high").isNotNull())
    alike = F.least("_chunks_low", "_queries_low") == F.greatest("_chunks_high", "_queries_high")
    whole = F.col("_large") & alike & (F.col("_chunks_able") == F.col("_chunks")) & (F.col("_queries_able") == F.col("_queries"))
    sizes = written(sizes.withColumn("_whole", F.coalesce(whole, F.lit(False))), "sizes")
    large = sizes.where("_large").select("document_id", F.col("_chunks_high").alias("_dims"), *[F.ceil(F.col(n) * F.col("_chunks_high") * 8 / BLOCK_BYTES).cast("int").alias(n) for n in ("_chunks", "_queries")])
    known = sizes.agg(F.count_if("_large").alias("large"), F.count_if(~F.col("_whole")).alias("rows")).first()
    if not known["large"]:
        return _as_rows(queries, chunks, k)
    # Such documents have over 500 rows on one side, so few are broadcast.
    c, q = (df.join(F.broadcast(large), "document_id", "left").withColumn("_met", F.coalesce(_length(vec) == F.col("_dims"), F.lit(False))) for df, vec in ((chunks, "vec"), (queries, "q_vec")))
    found = _as_blocks(q.where("_met"), c.where("_met"), k, large.agg(F.sum(F.col("_chunks") * F.col("_queries"))).first()[0])
    if known["rows"]:
        plain = lambda df, met, of: df.where(met).select(*of.columns)
        found = found.unionByName(_as_rows(queries, plain(c, "not _met", chunks), k).drop("rank")).unionByName(_as_rows(plain(q, "not _met", queries), plain(c, "_met", chunks), k).drop("rank"))
    return top_k(found, k, "chunk_id")


def _length(vec: str) -> Column:
    """The length of a vector that has a cosine, else null."""
    return F.when(has_cosine(vec), F.size(vec))


def _as_blocks(queries: DataFrame, chunks: DataFrame, k: int, blocks: int) -> DataFrame:
    """The k best chunks of each query in every block of its document. Both sides say into how many pieces (_chunks, _queries) a document's rows are dealt."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = chunks.select("document_id", F.pmod(F.xxhash64("chunk_id", "vec"), "_chunks").cast("int").alias("_piece"), every("_queries").alias("_block"), "chunk_id", "vec")
    asked = ["qid", "q_vec", *[n for n in ("own",) if n in queries.columns]]
    q = queries.select("document_id", F.pmod(F.xxhash64("qid", "q_vec"), "_queries").cast("int").alias("_block"), every("_chunks").alias("_piece"), *asked)
    key = ["document_id", "_piece", "_block"]
    c, q = (side.repartition(min(2 * blocks, PIECE_TASKS), *key) for side in (c, q))
    schema = StructType([queries.schema["qid"], chunks.schema["chunk_id"], chunks.schema["document_id"], StructField("score", DoubleType())])
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInArrow(lambda left, right: best_pairs(left, right, k), schema)


def _as_rows(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best chunks of each query's document, a row a pair. A document with many chunks and queries is dealt into pieces of both."""
    q = queries.withColumn("q_norm", F.sqrt(dot(F.col("q_vec"), F.col("q_vec"))))
    c = chunks.withColumn("c_norm", F.sqrt(dot(F.col("vec"), F.col("vec"))))
    pairs = _pieces(c, q)
    scored = _scored(_others(pairs).withColumn("_dot", dot(F.col("q_vec"), F.col("vec"))))
    return top_k(scored.select("qid", "chunk_id", "document_id", "score"), k, "chunk_id")


def _pieces(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """chunks joined with queries by document_id. Documents with more pairs than a piece are dealt over pieces, each pair in one of them; a piece's
    vectors stand once for each piece of the other side. Such documents have over 500 rows on one side, so few are broadcast.
    """
    sizes = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("_chunks")).join(queries.groupBy("document_id").agg(F.count(F.lit(1)).alias("_queries")), "document_id")
    large = sizes.where(F.col("_chunks") * F.col("_queries") > PIECE_CHUNKS * PIECE_QUERIES)
    needed = lambda n, most: F.ceil(F.col(n) / most).cast("int").alias(n)
    large = F.broadcast(written(large.select("document_id", needed("_chunks", PIECE_CHUNKS), needed("_queries", PIECE_QUERIES)), "large"))
    own = lambda n, *key: F.coalesce(F.pmod(F.xxhash64(*key), F.col(n)).cast("int"), F.lit(0))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    c = chunks.join(large, "document_id", "left").withColumn("_piece", own("_chunks", "chunk_id", "vec")).withColumn("_block", every("_queries")).drop("_chunks", "_queries")
    q = queries.join(large, "document_id", "left").withColumn("_block", own("_queries", "qid")).withColumn("_piece", every("_chunks")).drop("_chunks", "_queries")
    key = ["document_id", "_piece", "_block"]
    if n := large.agg(F.sum(F.col("_chunks") * F.col("_queries"))).first()[0]:
        # Pieces are few bytes and long work, so Spark would gather them in few tasks.
        c, q = (side.repartition(min(2 * n, PIECE_TASKS), *key) for side in (c, q))
    return c.join(q, key)


def to_documents(ranked: DataFrame) -> DataFrame:
    """Chunk ranking to document ranking: each document at its first place, ranked anew."""
    first = ranked.groupBy("qid", "document_id").agg(F.min("rank").alias("place"))
    return first.select("qid", "document_id", F.row_number().over(Window.partitionBy("qid").orderBy("place")).cast("long").alias("rank"))


def rerank_symbols(documents: DataFrame, symbols: DataFrame) -> DataFrame:
    """Stable partition: documents that the query names come first, all else in order (symbols: qid, document_id)."""
    named = documents.join(symbols.select("qid", "document_id").distinct().withColumn("named", F.lit(1)), ["qid", "document_id"], "left")
    order = Window.partitionBy("qid").orderBy(F.desc(F.coalesce("named", F.lit(0))), "rank")
    return named.select("qid", "document_id", F.row_number().over(order).cast("long").alias("rank"))


def fuse(lists: list[DataFrame], weights: tuple[float, ...] = WEIGHTS, k: int = FUSION_K) -> DataFrame:
    """Weighted reciprocal-rank fusion of rankings (qid, document_id, rank); ties keep the first list's order."""
    parts = [
        df.select("qid", "document_id", (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("l"), F.col("rank").alias("r")).alias("seen"))
        for i, (df, w) in enumerate(zip(lists, weights, strict=True))
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # Adding in list order gives one sum whatever the order rows arrive in.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seen", "part"))), lambda x: x["part"])
    fused = union.groupBy("qid", "document_id").agg(F.aggregate(ordered, F.lit(0.0), lambda s, x: s + x).alias("score"), F.min("seen").alias("seen"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "seen")
    return fused.select("qid", "document_id", "score", F.row_number().over(order).cast("long").alias("rank"))


def evidence(symbol_hits: DataFrame, dense_hits: DataFrame, k: int = K) -> DataFrame:
    """Evidence chunks: symbol hits by score, then dense hits by rank, each chunk once, k a query."""
    a = symbol_hits.select("qid", "chunk_id", "document_id", F.lit(0).alias("src"), (-F.col("score")).alias("key"), F.col("rank").cast("long").alias("pos"))
    b = dense_hits.select("qid", "chunk_id", "document_id", F.lit(1).alias("src"), F.col("rank").cast("double").alias("key"), F.col("rank").cast("long").alias("pos"))
    first = a.unionByName(b).groupBy("qid", "chunk_id", "document_id").agg(F.min(F.struct("src", "key", "pos")).alias("at"))
    order = Window.partitionBy("qid").orderBy("at", "chunk_id")
    return first.select("qid", "chunk_id", "document_id", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= k)


def citations(ranked: DataFrame, n: int = 3) -> DataFrame:
    """Distinct documents in order, the first n."""
    return to_documents(ranked).where(F.col("rank") <= n)


def first_seen(searches: list[DataFrame]) -> DataFrame:
    """Chunks of several searches, each at its first place (qid, chunk_id, rank): search number, then rank."""
    union = None
    for i, df in enumerate(searches):
        part = df.select("qid", "chunk_id", F.struct(F.lit(i).alias("s"), F.col("rank").alias("r")).alias("at"))
        union = part if union is None else union.unionByName(part)
    first = union.groupBy("qid", "chunk_id").agg(F.min("at").alias("at"))
    return first.select("qid", "chunk_id", F.row_number().over(Window.partitionBy("qid").orderBy("at")).cast("long").alias("rank"))


def numbered(df: DataFrame, *order: str, name: str = "_i") -> DataFrame:
    """A gapless number from 0 over a total order, without gathering all rows in one task.

    Rows are range-partitioned and written once with their places; each partition numbers its own rows after the counts
    of those before it.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    dealt = written(dealt, "numbered")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", "_first", before.alias("_before"))
    joined = dealt.join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_mono") - F.col("_first")).drop("_part", "_mono", "_first", "_before")


def stride_sample(df: DataFrame, k: int, *order: str) -> DataFrame:
    """Rows floor(i*n/k) of an order, for i under k; all rows if there are no more than k."""
    n = df.count()
    if n <= k:
        return df
    i = F.ceil(F.col("_i") * k / F.lit(n))
    return numbered(df, *order).where((i < k) & (F.floor(i * n / F.lit(k)) == F.col("_i"))).drop("_i")


def mentions(documents: DataFrame, names: DataFrame) -> DataFrame:
    """Documents (doc_id, text) and the names (name) they hold as whole tokens: doc_id, name.

    Texts meet names by equal tokens, a name of several by its first one; only then is the whole name looked for. Tokens travel without
    their text, which comes back by doc_id for names of several.
    """
    token = r"[A-Za-z0-9]+"
    read = lambda c: F.regexp_extract_all(F.lower(T.fold_dashes(c)), F.lit(token), F.lit(0))
    wanted = names.select("name", F.get(read(F.col("name")), F.lit(0)).alias("_token"), (~F.col("name").rlike(f"^{token}$")).alias("_several")).where("_token is not null").distinct()
    n = wanted.agg(F.count(F.lit(1)).alias("names"), F.count_if("_several").alias("several")).first()
    held = documents.select("doc_id", F.explode(F.array_distinct(read(F.col("text")))).alias("_token")).join(beside(wanted, n["names"]), "_token")
    found = held.where(~F.col("_several")).select("doc_id", "name")
    if not n["several"]:
        return found
    maybe = held.where("_several").select(F.col("doc_id").alias("_doc"), "name").distinct()
    whole = documents.join(maybe, F.col("doc_id").eqNullSafe(F.col("_doc"))).where(T.mentions(F.col("text"), F.col("name")))
    return found.unionByName(whole.select("doc_id", "name"))
