"""Substring search with BM25, and keyword recall by IDF coverage with rank fusion.

notes: id, title, question, conclusion, topic_id, created_s. queries: query_id, query. Many queries run at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower
from ..sources.store import sized, stored
from .activity import ordinals
from .recall_blocks import block_scores

#: Fixed values of the ranking: BM25's k1 and b, the weights of title, question and body.
K1, B, WEIGHTS = 1.2, 0.75, (("title", 3.0), ("question", 2.0), ("conclusion", 1.0))
#: Share of a question's weight a note must cover, and how much more a term in its head counts.
COVERAGE, HEAD = 0.25, 2.0
FUSION, CANDIDATES, TOPICS = 60, 30, 5
#: Queries up to this number are broadcast to the notes; a larger table is dealt in blocks of it.
QUERY_BLOCK = 10_000
#: Characters of a piece by which it meets words, and the windows that longer words are cut into.
KEY, WINDOW = 32, 1024

CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff"


def pieces(query: Column) -> Column:
    return F.filter(F.split(F.trim(query), r"\s+"), lambda p: p != "")


def _fields() -> list[Column]:
    return [F.lower(F.coalesce(F.col(c), F.lit(""))) for c, _ in WEIGHTS]


def _trigrams(low: Column) -> Column:
    """All runs of three characters, overlapping ones too."""
    return F.regexp_extract_all(low, F.lit("(?s)(?=(.{3}))"), F.lit(1))


def _hits(low: Column, piece: Column) -> Column:
    """Overlapping occurrences of a piece in a text, both in lower case."""
    quoted = F.replace(piece, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.regexp_count(low, F.concat(F.lit("(?=\\Q"), quoted, F.lit("\\E)")))


def _plain_hits(low: Column, piece: Column) -> Column:
    """The same for a piece that can't overlap itself: by what its text loses without it."""
    return (F.octet_length(low) - F.octet_length(F.replace(low, piece, F.lit("")))) / F.octet_length(piece)


def _overlaps(piece: Column) -> Column:
    """Whether two occurrences of a piece can overlap: it ends as it begins."""
    return F.exists(F.sequence(F.lit(1), F.length(piece) - 1), lambda n: F.left(piece, n) == F.right(piece, n))


def trigram_index(notes: DataFrame) -> DataFrame:
    """gram, id: the distinct trigrams of each note's title, question and body."""
    return notes.select("id", F.explode(F.array_distinct(F.concat(*(_trigrams(f) for f in _fields())))).alias("gram"))


def query_grams(queries: DataFrame) -> DataFrame:
    """gram: the distinct trigrams of the queries' pieces."""
    parts = _parts(queries).select(F.explode("long").alias("piece"))
    return parts.select(F.explode(_trigrams(F.col("piece"))).alias("gram")).distinct()


def piece_hits(pieces_: DataFrame, notes: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """piece, id, tf (weighted occurrences) for each note that holds a piece (lower case, three characters or more).

    A piece meets the notes that have its rarest trigram, and those are looked through. index: the trigrams of the notes (gram,
    id; those of the pieces are enough), if they are kept.
    """
    index = stored(trigram_index(notes) if index is None else index)
    asked = stored(pieces_.select("piece").distinct())
    grams = asked.select("piece", F.explode(F.array_distinct(_trigrams(F.col("piece")))).alias("gram"))
    known = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counted = grams.join(known.hint("shuffle_merge"), "gram", "left").select("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    rarest = stored(counted.groupBy("piece").agg(F.min("g").alias("g")).where("g.n > 0").select("piece", "g.gram"))
    near = stored(index.join(rarest.hint("shuffle_merge"), "gram").select("piece", "id"))
    looked = near.join(notes.select("id", *(f.alias(f"field_{k}") for k, f in enumerate(_fields()))).hint("shuffle_merge"), "id")
    tf = sum((F.lit(w) * _hits(F.col(f"field_{k}"), F.col("piece")) for k, (_, w) in enumerate(WEIGHTS)), F.lit(0.0))
    holds = [F.contains(f"field_{k}", "piece") for k in range(len(WEIGHTS))]
    return looked.where(holds[0] | holds[1] | holds[2]).select("piece", "id", tf.alias("tf"))


def _parts(queries: DataFrame) -> DataFrame:
    """query_id, long and short: a query's pieces of three characters or more, in lower case, and the others."""
    q = queries.select("query_id", pieces(F.col("query")).alias("pieces"))
    return q.select("query_id", F.transform(F.filter("pieces", lambda p: F.length(p) >= 3), F.lower).alias("long"), F.filter("pieces", lambda p: F.length(p) < 3).alias("short"))


def note_words(notes: DataFrame) -> DataFrame:
    """word, id: the distinct words between blanks, of three characters or more and in lower case, of each note's title, question and body."""
    words = F.array_distinct(F.concat(*(F.split(f, r"\s+") for f in _fields())))
    return notes.select("id", F.explode(F.filter(words, lambda w: F.length(w) >= 3)).alias("word")).select("word", "id")


def _holders(pieces_: DataFrame, words: DataFrame) -> DataFrame:
    """piece, word, n: the words (word, id) that hold each piece (in lower case, without blanks), and the notes that have the word.

    A piece has no blank, so a note holds it if one of its words does. Each distinct word gives its substrings of up to KEY
    characters, in windows, and these meet the pieces' first KEY characters.
    """
    asked = sized(pieces_.select("piece").distinct().withColumn("key", F.substring("piece", 1, KEY)))
    known = stored(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    windows = known.select("word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word"), F.lit(WINDOW)), lambda i: F.substring(F.col("word"), i, F.lit(WINDOW + KEY - 1)))).alias("w")).where(F.length("w") >= 3)
    sizes = windows.select("*", F.explode(F.sequence(F.lit(3), F.least(F.lit(KEY), F.length("w")))).alias("size"))
    runs = sizes.select("*", F.explode(F.sequence(F.lit(1), F.length("w") - F.col("size") + 1)).alias("at")).withColumn("key", F.expr("substring(w, at, size)"))
    # What a window holds twice counts where it stands first.
    met = runs.where("instr(w, key) = at").select("word", "n", "key").join(asked, "key").where(F.contains("word", "piece"))
    # Neighbouring windows share characters, so only longer words can meet a piece twice.
    longer = F.length("word") > WINDOW
    return met.where(~longer).select("piece", "word", "n").unionByName(met.where(longer).select("piece", "word", "n").distinct())


def _rarest(each: DataFrame, held: DataFrame) -> DataFrame:
    """query_id, piece: the piece of each query that the fewest notes can hold, by the sum over its words; none if a piece is in no word."""
    most = held.groupBy("piece").agg(F.sum("n").alias("n"))
    least = each.join(most.hint("shuffle_merge"), "piece", "left").groupBy("query_id").agg(F.min(F.struct("n", "piece")).alias("g"), F.bool_and(F.col("n").isNotNull()).alias("all"))
    return least.where("all").select("query_id", "g.piece")


def _matches(parts: DataFrame, notes: DataFrame, words: DataFrame, held: DataFrame, rarest: DataFrame) -> DataFrame:
    """substring_matches of the queries' parts (all their columns but short stay), with the fields in lower case (field_0 to field_2).

    The notes that hold a query's rarest piece (query_id, piece) are looked through for all of its pieces.
    """
    plain = [ascii_lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "conclusion")]
    texts = notes.select("*", *(f.alias(f"field_{k}") for k, f in enumerate(_fields())), *(f.alias(f"plain_{k}") for k, f in enumerate(plain)))
    short = F.forall("short", lambda p: F.contains("plain_0", ascii_lower(p)) | F.contains("plain_1", ascii_lower(p)))
    long = F.forall("long", lambda p: F.contains("field_0", p) | F.contains("field_1", p) | F.contains("field_2", p))
    asked = parts.where(F.size("long") > 0).withColumn("n_long", F.size(F.array_distinct("long")))
    of_words = held.join(rarest.select("piece").distinct().hint("shuffle_merge"), "piece").select("piece", "word")
    near = stored(words.join(of_words.hint("shuffle_merge"), "word").select("piece", "id").repartition("piece", "id").distinct())
    looked = near.join(stored(asked.join(rarest.hint("shuffle_merge"), "query_id")).hint("shuffle_merge"), "piece").drop("piece")
    met = texts.join(looked.hint("shuffle_merge"), "id").where(long & short).drop("short")
    bare = parts.where(F.size("long") == 0).withColumn("n_long", F.lit(0))
    n_blocks = -(-bare.count() // QUERY_BLOCK)
    block = F.pmod(F.xxhash64("query_id", "short"), F.lit(n_blocks))
    for k in range(n_blocks):
        met = met.unionByName(texts.join(F.broadcast(bare.where(block == k)), short).drop("short"))
    return met.drop("plain_0", "plain_1")


def _asked_pieces(queries: DataFrame) -> DataFrame:
    """query_id, piece: the pieces of three characters or more, repeated ones too."""
    return _parts(queries).select("query_id", F.explode("long").alias("piece"))


def substring_matches(queries: DataFrame, notes: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """query_id, n_long and the note of each match: every piece of three characters or more is in title, question or body,
    and every shorter one in title or body with ASCII case folding. An empty query matches all.

    words: note_words of the notes, if they are kept. Queries without a longer piece go to all notes; up to QUERY_BLOCK
    of them are broadcast to the notes, and more are dealt by their hash into blocks of about that size.
    """
    words = stored(note_words(notes) if words is None else words)
    held = stored(_holders(_asked_pieces(queries), words))
    rarest = stored(_rarest(_asked_pieces(queries), held))
    return _matches(_parts(queries), notes, words, held, rarest).drop("long", "field_0", "field_1", "field_2")


def bm25_search(queries: DataFrame, notes: DataFrame, limit: int = 20) -> DataFrame:
    """The first `limit` notes of each query's ranking."""
    return bm25_ranking(queries, notes, limit=limit)


def bm25_ranking(queries: DataFrame, notes: DataFrame, words: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """query_id, rank, id, score: substring matches by BM25 of the weighted hits, without long piece newest first.

    A note's length is its number of trigrams over the three columns; a piece's frequency n is the notes that hold it.
    Statistics cover all notes. words: as in substring_matches. limit: only the first so many of each query.

    Queries of the same pieces are ranked once. A match is scored where it is found, and of those of a task only the first
    `limit` of a query go on.
    """
    grams = sum((F.greatest(F.lit(0), F.length(F.coalesce(F.col(c), F.lit(""))) - 2) for c, _ in WEIGHTS), F.lit(0))
    measured = notes.withColumn("n_grams", grams)
    totals = stored(measured.agg(F.count(F.lit(1)).alias("n_all"), F.avg("n_grams").alias("avg_grams")))
    words = stored(note_words(notes) if words is None else words)
    every = stored(_parts(queries))
    parts = stored(every.groupBy("long", "short").agg(F.min("query_id").alias("query_id")))
    pieces_ = parts.select("query_id", F.explode("long").alias("piece"))
    held = stored(_holders(pieces_, words))
    rarest = stored(_rarest(pieces_, held))
    weighed = parts.join(_weighed(parts, rarest, words, held, totals).hint("shuffle_merge"), "query_id", "left")
    met = _matches(weighed, measured.crossJoin(F.broadcast(totals)), words, held, rarest)
    tf = lambda p, hits: sum((F.lit(w) * hits(F.col(f"field_{k}"), p) for k, (_, w) in enumerate(WEIGHTS)), F.lit(0.0))
    found = F.transform("weighed", lambda h: F.struct(h.idf.alias("idf"), F.when(h.overlaps, tf(h.piece, _hits)).otherwise(tf(h.piece, _plain_hits)).alias("tf")))
    part = lambda h: h.idf * h.tf * (K1 + 1) / (h.tf + K1 * (1 - B + B * F.col("n_grams") / F.col("avg_grams")))
    score = F.when(F.col("n_long") > 0, F.round(F.aggregate(found, F.lit(0.0), lambda x, h: x + part(h)), 6)).otherwise(0.0)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(F.when(F.col("score") == 0, F.col("created_s"))), "id")
    ranked = met.select("query_id", "id", "created_s", score.alias("score")).withColumn("rank", F.row_number().over(order))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    same = every.join(parts.withColumnRenamed("query_id", "first").hint("shuffle_merge"), ["long", "short"]).select("query_id", "first")
    out = ranked.withColumnRenamed("query_id", "first").join(same.hint("shuffle_merge"), "first")
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")


def _weighed(parts: DataFrame, rarest: DataFrame, words: DataFrame, held: DataFrame, totals: DataFrame) -> DataFrame:
    """query_id, weighed: piece, idf and whether it overlaps itself, of each of a query's pieces in their order; only of queries whose
    pieces are all held."""
    each = stored(parts.join(rarest.select("query_id").hint("shuffle_merge"), "query_id", "left_semi").select("query_id", F.posexplode("long").alias("at", "piece")))
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_all") - F.col("n_with") + 0.5) / (F.col("n_with") + 0.5)))
    known = _frequency(each.select("piece").distinct(), words, held).crossJoin(F.broadcast(totals)).select("piece", idf.alias("idf"), _overlaps(F.col("piece")).alias("overlaps"))
    rows = each.join(stored(known).hint("shuffle_merge"), "piece")
    return stored(rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "idf", "overlaps"))).alias("weighed")))


def _frequency(pieces_: DataFrame, words: DataFrame, held: DataFrame) -> DataFrame:
    """piece, n_with: the notes that hold each of these pieces."""
    wanted = held.join(pieces_.hint("shuffle_merge"), "piece")
    told = stored(wanted.withColumn("n_words", F.count(F.lit(1)).over(Window.partitionBy("piece"))))
    one = told.where("n_words = 1").select("piece", F.col("n").alias("n_with"))
    codes = stored(told.where("n_words > 1").select("piece").distinct().withColumn("code", F.monotonically_increasing_id()))
    several = told.where("n_words > 1").select("piece", "word").join(codes.hint("shuffle_merge"), "piece").select("code", "word")
    # Dealt before rows are made distinct: a word's notes are few of a piece's, so there is little to drop earlier.
    notes = words.join(several.hint("shuffle_merge"), "word").select("code", "id").repartition("code", "id").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("n_with"))
    return one.unionByName(codes.join(notes.hint("shuffle_merge"), "code").select("piece", "n_with"))


def terms(text: Column) -> Column:
    """Distinct lower-case words of two characters or more (letters, digits, + and #), and CJK pairs (a lone one as itself)."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}+#&&[^{CJK}]]+"), F.lit(0)), lambda w: F.length(w) >= 2)
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    pairs = lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))
    return F.array_distinct(F.concat(words, F.flatten(F.transform(runs, pairs))))


def note_terms(notes: DataFrame) -> DataFrame:
    """The inverted index: term, id and its weight in the note (head or body)."""
    head = terms(F.concat_ws("\n", "title", "question"))
    both = notes.select("id", head.alias("head"), terms(F.coalesce(F.col("conclusion"), F.lit(""))).alias("body"))
    once = both.select("id", "head", F.array_except("body", "head").alias("body"))
    weighted = F.concat(F.transform("head", lambda t: F.struct(t.alias("term"), F.lit(HEAD).alias("weight"))), F.transform("body", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight"))))
    return once.select("id", F.explode(weighted).alias("t")).select("id", "t.term", "t.weight")


def term_idf(index: DataFrame, notes: DataFrame) -> DataFrame:
    """term, df, idf = ln(1 + N / (df + 1))."""
    n = notes.agg(F.count(F.lit(1)).alias("n_all"))
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", "df", F.log(1 + F.col("n_all") / (F.col("df") + 1)).alias("idf"))


def keyword_recall(questions: DataFrame, notes: DataFrame, index: DataFrame | None = None, limit: int | None = None, **how) -> DataFrame:
    """query_id, id, score, rank: notes that cover a quarter of a question's weight, best first, ties newest first.

    questions: query_id, query; a repeated row counts once. Questions and notes meet in blocks (recall_blocks), where a note's score is
    summed up in place; rows are made of what is recalled alone. index: note_terms of the notes (those of the questions' terms are
    enough), if they are kept. limit: only the first so many of each question. how: share and groups of recall_blocks.
    """
    asked = stored(questions.select("query_id", F.explode(terms(F.col("query"))).alias("term")).distinct())
    codes = sized(asked.select("term").distinct().withColumn("code", F.monotonically_increasing_id()))
    coded = lambda rows, *columns: rows.join(codes, "term").select(F.col("code").alias("term"), *columns)
    postings = stored(coded(note_terms(notes) if index is None else index, "id", "weight"))
    weighted, total = question_weights(coded(asked, "query_id"), postings, notes)
    notes = stored(notes.select("id", "created_s"))
    score = block_scores(weighted.where("df IS NOT NULL"), stored(total), postings, notes, COVERAGE, limit=limit, **how)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("created_s"), "id")
    ranked = score.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "id", "score", "rank")
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def question_weights(asked: DataFrame, index: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, term, df (null if no note has the term), idf of the asked terms; and query_id, total of each question."""
    n = notes.agg(F.count(F.lit(1)).alias("n_all"))
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Terms that no note has count in the question's weight too.
    idf = F.log(1 + F.col("n_all") / (F.coalesce("df", F.lit(0)) + 1))
    weighted = stored(asked.join(df.hint("shuffle_merge"), "term", "left").crossJoin(F.broadcast(n)).select("query_id", "term", "df", idf.alias("idf")))
    return weighted, weighted.groupBy("query_id").agg((F.sum("idf") * HEAD).alias("total"))


def fused(*rankings: DataFrame) -> DataFrame:
    """query_id, id, score, rank by reciprocal rank fusion of rankings (query_id, id, rank); ties by id."""
    both = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        both = both.unionByName(r.select("query_id", "id", "rank"))
    score = both.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (FUSION + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return score.withColumn("rank", F.row_number().over(order).cast("long"))


def best_topics(ranking: DataFrame, notes: DataFrame, limit: int = TOPICS, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, topic_id: the topics of each query's first candidates, in order."""
    first = ranking.where(F.col("rank") <= candidates).join(notes.select("id", "topic_id").hint("shuffle_merge"), "id").groupBy("query_id", "topic_id").agg(F.min("rank").alias("best"))
    order = Window.partitionBy("query_id").orderBy("best", "topic_id")
    return first.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= limit).select("query_id", "rank", "topic_id")


def recalled_topics(ranking: DataFrame, notes: DataFrame, limit: int = TOPICS, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, topic_id, ask_count, note_ids: topics of the first candidates in order, each with all its notes."""
    top = best_topics(ranking, notes, limit, candidates)
    of_topic = notes.groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("created_s", "id"))).alias("found"))
    return top.join(of_topic, "topic_id").select("query_id", "rank", "topic_id", F.size("found").cast("long").alias("ask_count"), F.array_join(F.col("found.id").cast("array<string>"), ",").alias("note_ids"))


def recalled_notes(ranking: DataFrame, notes: DataFrame, limit: int = TOPICS, candidates: int = CANDIDATES) -> DataFrame:
    """topic_id, place, id: the notes of every topic that some query recalls, once each, numbered oldest first.

    With best_topics this says what recalled_topics does, without a list of a whole topic in one row for each query.
    """
    topics = best_topics(ranking, notes, limit, candidates).select("topic_id").distinct()
    members = notes.select("topic_id", "id", "created_s").join(topics.hint("shuffle_merge"), "topic_id", "left_semi")
    return ordinals(members, "topic_id", [F.col("created_s").asc(), F.col("id").asc()], "place").select("topic_id", F.col("place").cast("long").alias("place"), "id")
