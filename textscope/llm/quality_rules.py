"""Quality rules under weak supervision.

Rules vote a text good or bad, or abstain. Expectation-maximisation over the
counts of vote patterns estimates how often each rule votes, and errs, on good
and on bad texts; the posterior probability of "good" replaces a filter that
every rule must pass. All of it is DataFrame expressions: counts come from
arrays inside each row, so no text or word is shuffled; only the table of
vote patterns, at most 3 ** rules rows whatever the corpus, reaches the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_text, materialize, table
from .spans import literal

MIN_WORDS = 50
#: Percent of words in repeated windows from which a text fails outright.
MAX_REPEAT = 50
#: Words of a text up to which a window's place fits beside its hash.
SHORT = 1 << 20
PRIOR_GOOD = 0.8
EM_ROUNDS = 100
KEEP_FROM = 0.5
#: Shares of a rule's votes on good (1) and bad (0) texts, before any is seen.
START = {1: {"g": 0.93, "b": 0.005, "-": 0.065}, 0: {"g": 0.72, "b": 0.18, "-": 0.10}}
#: Texts of each class that the shares of ``START`` count for, whatever the corpus: beside a
#: large one they fade.
PRIOR_TEXTS = 600

#: A symbol three times in a row.
RUN = r"([#*$%&|<>])\1\1"

_SPACE = "[\\x20\\x09-\\x0D]+"


def _repeat_words(words: str) -> str:
    """SQL: how many words lie in 3-word windows that occur twice or more.

    Each window becomes a long of 43 hash bits and its 20-bit place; after one
    sort, equal windows are neighbours, and neighbours are compared word by word.
    The places of the repeated ones, sorted, cover up to three words each. Longer
    texts use (hash, place) pairs, which need no room in one long."""
    n = f"size({words})"
    windows = f"sequence(0, {n} - 3)"
    hashed = f"xxhash64({words}[i], {words}[i + 1], {words}[i + 2])"
    mask = "1048575"
    same = lambda p, q: f"({words}[{p}] = {words}[{q}] and {words}[{p} + 1] = {words}[{q} + 1] and {words}[{p} + 2] = {words}[{q} + 2])"
    near = lambda j: f"(shiftright(x ^ k[{j}], 20) = 0 and {same('int(x & ' + mask + ')', f'int(k[{j}] & {mask})')})"
    short = f"""element_at(transform(array(array_sort(transform({windows}, i -> ((shiftright({hashed}, 1) & (-1L ^ {mask})) | i)))),
      k -> transform(filter(k, (x, j) -> (j > 0 and {near('j - 1')}) or (j < size(k) - 1 and {near('j + 1')})), x -> int(x & {mask}))), 1)"""
    long = f"""element_at(transform(array(array_sort(transform({windows}, i -> named_struct('h', {hashed}, 'i', i)))),
      k -> transform(filter(k, (x, j) -> (j > 0 and x.h = k[j - 1].h and {same('x.i', 'k[j - 1].i')}) or (j < size(k) - 1 and x.h = k[j + 1].h and {same('x.i', 'k[j + 1].i')})), x -> x.i)), 1)"""
    covered = """element_at(transform(array(array_sort({places})), p -> bigint(aggregate(sequence(0, size(p) - 1), 0,
      (a, j) -> a + if(j = size(p) - 1, 3, least(3, p[j + 1] - p[j]))))), 1)"""
    return f"""case when {n} < 4 then 0L else element_at(transform(array(if({n} < {SHORT}, {short}, {long})),
      r -> if(size(r) = 0, 0L, {covered.format(places='r')})), 1) end"""


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long), n_upper, n_bars, n_ends, n_runs (long) and base_failed.

    Null text: no word. Columns of docs with these names are replaced."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_bars", "n_ends", "n_runs", "base_failed"]
    held = docs.drop(*made).withColumn("__t", as_text(text))
    held = held.withColumn("__w", F.expr(f"filter(split(__t, {literal(_SPACE)}), w -> w <> '')"))
    held = held.withColumn("__l", F.expr(f"filter(split(__t, '\\n'), l -> l rlike {literal('[^\\x20\\x09-\\x0D]')})"))
    size_ = lambda x: f"bigint(length({x}))"
    held = held.withColumns(
        {
            "n_words": F.expr("bigint(size(__w))"),
            "word_chars": F.expr(size_("translate(__t, ' \\t\\n\\u000B\\u000C\\r', '')")),
            "n_symbols": F.expr(size_("__t") + " - " + size_("translate(__t, '#*$%&|<>', '')")),
            "n_dup_lines": F.expr("bigint(size(__l) - size(array_distinct(__l)))"),
            "n_repeat_words": F.expr(_repeat_words("__w")),
            "n_upper": F.expr(size_("__t") + " - " + size_("translate(__t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')")),
            "n_bars": F.expr(size_("__t") + " - " + size_("translate(__t, '|!', '')")),
            "n_ends": F.expr(size_("__t") + " - " + size_("translate(__t, '.?', '')")),
        }
    )
    held = held.withColumn("n_runs", F.expr(f"if(n_symbols < 3, 0L, bigint(regexp_count(__t, {literal(RUN)})))"))
    return held.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words")).drop("__t", "__w", "__l")


#: name -> (condition of a vote for good, condition of a vote for bad), over measured columns.
RULES = {
    "length": ("n_words >= 80", "n_words < 50"),
    "repeats": ("10 * n_repeat_words <= 3 * n_words", "2 * n_repeat_words > n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "runs": ("n_runs = 0", "20 * n_runs > n_words"),
    "lines": ("n_dup_lines = 0", "n_dup_lines >= 3"),
    "capitals": ("5 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    "marks": ("50 * n_bars <= n_words", "5 * n_bars > n_words"),
    "sentences": ("60 * n_ends >= n_words and n_ends > 0", "400 * n_ends < n_words"),
    "word_length": ("word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
}


def votes(measured: DataFrame) -> DataFrame:
    """measured with ``votes``: one letter a rule, g, b, or - where it abstains."""
    return measured.withColumn("votes", F.expr("concat(" + ", ".join(f"case when {g} then 'g' when {b} then 'b' else '-' end" for g, b in RULES.values()) + ")"))


def posteriors(patterns: dict[str, int], prior: float = PRIOR_GOOD, rounds: int = EM_ROUNDS) -> dict[str, float]:
    """P(good | votes) of each pattern, by expectation-maximisation on counts.

    Every rule has, for each class, the shares of its three votes; rules are
    independent given the class. The shares of ``START`` begin the rounds and count
    for ``PRIOR_TEXTS`` texts of each class in each of them, so that votes never
    seen keep a share; on all but small corpora the texts decide."""
    rules = len(next(iter(patterns), ""))
    share = {c: [dict(START[c]) for _ in range(rules)] for c in (1, 0)}
    good = prior
    out: dict[str, float] = {}
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(good / (1 - good)) + sum(math.log(share[1][k][v] / share[0][k][v]) for k, v in enumerate(p))
            out[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        total = sum(patterns.values())
        weight = {c: sum(n * (out[p] if c else 1 - out[p]) for p, n in patterns.items()) for c in (1, 0)}
        good = min(0.999, max(0.001, (weight[1] + 1) / (total + 2)))
        for c in (1, 0):
            for k in range(rules):
                for v in "gb-":
                    own = sum(n * (out[p] if c else 1 - out[p]) for p, n in patterns.items() if p[k] == v)
                    share[c][k][v] = (own + PRIOR_TEXTS * START[c][v]) / (weight[c] + PRIOR_TEXTS)
    return out


def judge(docs: DataFrame, text: str = "text", keep_from: float = KEEP_FROM, carry: list[str] | None = None) -> DataFrame:
    """The carried columns of docs (all but the text unless named), the measures,
    votes, quality (posterior probability of good) and kept, one row per row;
    columns of docs with these names are replaced.

    Null, empty and wordless texts fail (n_words < 50). Ties with ``keep_from``
    are kept. Repeated rows count as often as they occur. Empty: empty."""
    made = {"votes", "quality", "kept"}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made and (carry is not None or c != text)]
    held = materialize(votes(measure(docs.select(*carry, *([text] if text not in carry else [])), text)).drop(*([text] if text not in carry else [])), "votes")
    found = posteriors({r.votes: r["count"] for r in held.groupBy("votes").count().collect()})
    spark = docs.sparkSession
    scores = spark.createDataFrame(sorted(found.items()), "votes string, quality double")
    joined = held.join(F.broadcast(scores), "votes", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", "votes")
