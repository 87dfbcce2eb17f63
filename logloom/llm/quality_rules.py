"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule looks at counts of one text and votes good (1), bad (-1) or abstains (0). Expectation-maximisation
over the counts of vote patterns estimates, for good texts and for each kind of bad ones, how often each rule
votes bad, votes good and abstains; each text then gets the posterior probability of being good, in place of
"all rules must pass". Bad texts are of two kinds, noisy and repetitive, as the rules for one kind of damage say
nothing of the other: with one kind, the estimation settles on the commoner damage and takes the rest for good.

All rates are estimated freely. The kinds are told apart by where the estimation starts and by a few
pseudo-texts, which any real number of texts outweighs.

The vote patterns number at most MOST_PATTERNS, whatever the corpus' size: that bound is what lets the
estimation run on one row and its result be broadcast. No text leaves the scan: one pass computes counts
and votes, which are written to the shared folder and used for both the estimation and the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.staging import scratch, stage

WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

#: A word of letters, with the marks that may stand before and after one.
PLAIN_WORD = r"""(?<![^\x20\x09-\x0D])[("'\u00bf\u00a1\u00ab]?\p{L}[\p{L}\p{M}'\u2019-]*+[.,;:!?)"'\u00bb]*+(?![^\x20\x09-\x0D])"""

GOOD, NOISY, REPETITIVE = range(3)
#: name -> (votes bad when, votes good when, the kind of bad text it looks for); SQL conditions over the counts of
#: ``counted``. A rule whose second condition is None looks for damage: where it sees none it abstains.
RULES = {
    "length": ("n_words < 20", "n_words >= 40", None),
    "word_length": ("word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words", None),
    "sentence_ends": ("n_words >= 20 AND 100 * n_stops < n_words", "50 * n_stops >= n_words", None),
    "plain_words": ("4 * n_plain < 3 * n_words", "10 * n_plain >= 9 * n_words", NOISY),
    "symbols": ("10 * n_symbols > n_words", None, NOISY),
    "duplicate_lines": ("10 * n_dup_lines > 3 * n_lines", None, REPETITIVE),
    "repeated_words": ("5 * n_repeat_words > n_words", None, REPETITIVE),
    "upper_case": ("10 * n_upper > 3 * word_chars", None, REPETITIVE),
    "exclamations": ("10 * n_exclaims > n_words", None, REPETITIVE),
}
MOST_PATTERNS = 3**4 * 2**5
#: Where the estimation starts: the shares of the kinds, and how often rules vote bad on the kind they look for, on
#: bad texts in general (rules that look for no kind), and on others. Rules that can vote good do so on START_UP of the rest.
START_SHARES, START_OWN, START_BAD, START_OTHER, START_UP = (0.8, 0.1, 0.1), 0.5, 0.05, 0.02, 0.7
PSEUDO_TEXTS = 10


def counted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text; one row per input row, without shuffle.

    Words are the maximal runs of characters other than space and U+0009 to U+000D. A five-word window
    counts as repeated if its five words occur at two or more places of the text; windows are compared by a
    64-bit hash of their words' 64-bit hashes, within one text. Sorting makes this n log n in the words.
    """
    t = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("words", F.filter(F.split("text", WORD_BREAK), lambda w: w != ""))
    t = t.withColumn("lines", F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))

    def kept_length(pattern: str):
        return F.length(F.regexp_replace("text", pattern, "")).cast("long")

    t = t.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        kept_length(r"[^#*$%&|<>]+").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        kept_length(r"[^A-Z]+").alias("n_upper"),
        kept_length(r"[^.!?]+").alias("n_stops"),
        kept_length(r"[^!]+").alias("n_exclaims"),
        F.regexp_count("text", F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    t = t.withColumn(
        "windows",
        F.expr("CASE WHEN n_words >= 5 THEN transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4])) ELSE array() END"),
    ).drop("h")
    t = t.withColumn(
        "ordered",
        F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (x, i) -> struct(x AS x, i AS i))) END"),
    ).drop("windows")
    t = t.withColumn(
        "at",
        F.expr("""
            sort_array(transform(
                filter(sequence(0, size(ordered) - 1),
                       k -> (k > 0 AND get(ordered, k - 1).x = ordered[k].x) OR get(ordered, k + 1).x <=> ordered[k].x),
                k -> ordered[k].i))
        """),
    ).drop("ordered")
    return t.withColumn(
        "n_repeat_words",
        F.expr("CASE WHEN at IS NULL THEN 0L ELSE aggregate(sequence(0, size(at) - 1), 0L, (n, k) -> n + least(5, coalesce(get(at, k + 1) - at[k], 5))) END"),
    ).drop("at")


def start_rates(kind: int) -> list[list[float]]:
    """For each rule how often it votes bad, abstains and votes good on texts of a kind, where the estimation starts."""
    rates = []
    for _, good, own in RULES.values():
        down = START_OWN if own == kind else START_BAD if own is None and kind != GOOD else START_OTHER
        up = START_UP * (1 - down) if good else 0.0
        rates.append([down, 1 - down - up, up])
    return rates


def _estimate(iterations: int) -> str:
    """SQL over ``p``, the array of (votes, n): expectation-maximisation, then each pattern's posterior.

    ``t`` has for each kind its share and, for each rule, the rates of its three votes.
    """
    rules = f"sequence(0, {len(RULES)} - 1)"
    # transform(array(x), y -> ...)[0] names a value, so that it is computed once
    scores = f"transform(t, kind -> aggregate({rules}, ln(kind.share), (s, r) -> s + ln(kind.rates[r][pattern.votes[r] + 1])))"
    odds = f"transform(array({scores}), s -> transform(s, x -> exp(x - array_max(s))))[0]"
    posterior = f"transform(array({odds}), o -> transform(o, x -> x / aggregate(o, 0D, (a, b) -> a + b)))[0]"

    def total(start: str, what: str) -> str:
        return f"aggregate(sequence(0, size(p) - 1), {start}, (s, i) -> s + p[i].n * ({what}))"

    prior = "array({})".format(", ".join("array({})".format(", ".join("array({})".format(", ".join(f"{x!r}D" for x in rule)) for rule in start_rates(k))) for k in range(3)))
    shares = "array({})".format(", ".join(f"{x!r}D" for x in START_SHARES))
    rate = total(f"{PSEUDO_TEXTS} * {prior}[k][r][v]", "CASE WHEN p[i].votes[r] = v - 1 THEN q[i][k] ELSE 0D END")
    step = f"""
        transform(array(transform(p, pattern -> {posterior})), q -> transform(sequence(0, 2), k -> transform(array({total(f"{PSEUDO_TEXTS}D", "q[i][k]")}), n_kind -> named_struct(
            'share', {total(f"{PSEUDO_TEXTS} * {shares}[k]", "q[i][k]")} / {total(f"{PSEUDO_TEXTS}D", "1D")},
            'rates', transform({rules}, r -> transform(sequence(0, 2), v -> {rate} / n_kind))))[0]))[0]
    """
    start = f"transform(sequence(0, 2), k -> named_struct('share', {shares}[k], 'rates', {prior}[k]))"
    return f"""
        transform(array(aggregate(sequence(1, {iterations}), {start}, (t, _) -> {step})), t ->
            transform(p, pattern -> named_struct('votes', pattern.votes, 'p_good', {posterior}[{GOOD}])))[0]
    """


def voted(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``counted`` with the rules' ``votes`` and ``base_failed``."""
    t = counted(documents, id_col, text_col)
    votes = [F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good or 'false'} THEN 1 ELSE 0 END") for bad, good, _ in RULES.values()]
    return t.withColumn("votes", F.array(*votes)).withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def posteriors(votes: DataFrame, iterations: int = 30) -> DataFrame:
    """(pattern, p_good) of each vote pattern of the corpus; at most MOST_PATTERNS rows."""
    patterns = votes.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    estimated = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p")).where("size(p) > 0")
    return estimated.select(F.inline(F.expr(_estimate(iterations)))).withColumnRenamed("votes", "pattern")


def judged(votes: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``voted`` rows with their pattern's ``p_good`` and the verdict ``kept``."""
    joined = votes.join(F.broadcast(found), votes["votes"] == found["pattern"]).drop("pattern")  # bounded, see posteriors
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", iterations: int = 30, threshold: float = 0.5) -> DataFrame:
    """Counts, votes, posterior probability ``p_good`` and the verdict ``kept``; one row per input row.

    ``base_failed`` (too few words, or too many repeated ones) overrides the posterior. Null and empty
    texts have no words and fail; null ids are kept as they are; repeated rows are judged alike; an empty
    table gives no rows. Other columns are not read, so their names cannot clash.
    """
    votes = stage(voted(documents, id_col, text_col), "quality")
    return judged(votes, posteriors(votes, iterations), threshold)


def keep_good(documents: DataFrame, text_col: str = "text", iterations: int = 30, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that ``quality`` keeps, with all their columns and without moving any.

    The votes are taken once to estimate the posteriors and once more, in the scan, to filter.
    """
    with scratch(documents.sparkSession):
        found = stage(posteriors(stage(voted(documents, text_col, text_col).select("votes"), "votes"), iterations), "posteriors", keep=True)
    rows = documents.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    # a filter moves down through projections by repeating their expressions, here array functions within array
    # functions; it stops at a projection whose values depend on the row's place
    votes = voted(rows, "row").withColumn("place", F.monotonically_increasing_id())
    return judged(votes, found, threshold).where("kept AND place >= 0").select("doc_id.*")
