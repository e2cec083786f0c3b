"""Quality rules as weak supervision.

Each rule votes good or bad on a text or abstains; rules may contradict each other.
Expectation-maximisation over how often each combination of votes occurs estimates, for
each rule and class, how likely each vote is, and the share of good texts. A text's
verdict is its posterior probability of being good, given its votes, so a rule that errs
often is outvoted by those that don't. Texts that fail the base checks go anyway, and
nothing is learnt from them.

What is believed beforehand weighs as much as ``TEXTS`` texts, whatever the table's size.
There are at most 3 ** len(rules()) combinations of votes, so their table is bounded and
the estimation runs on it alone; the counts behind it cover all texts.

Null and blank texts have no words, fail the base and abstain on every rule that needs
some. Every row is judged by itself: equal texts get equal verdicts, repeated ids have a
row each. With no texts nothing is estimated and the result is empty. Distinct words are counted
in windows of ``WINDOW`` words, so a long text is judged as its parts would be; of a text a
task holds its lines, its distinct words and some numbers for each word.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, pieces, small_batches

GOOD, BAD, ABSTAIN = 1, 0, 2
#: Posterior probability from which a text is kept; rounds of estimation.
KEEP, ROUNDS = 0.5, 200
#: What is believed beforehand: the share of good texts, how likely a vote is bad in bad and in good texts, and how many texts that weighs.
SHARE, BAD_VOTES, TEXTS = 0.8, (0.5, 0.05), 20

_WORD = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
#: What stands in words and is neither a letter nor a mark upon one; capital letters.
_OTHER, _UPPER = regex.compile(r"[^\p{L}\p{M}\x20\x09-\x0D]"), regex.compile(r"\p{Lu}")
SPAN = 8


#: Words of a window in which distinct ones are counted: their share does not fall with a text's length.
WINDOW = 1000
#: Characters from which a text's words are taken one by one, not as a list.
LONG = 1 << 20


def word_ids(text: str) -> tuple[np.ndarray, int]:
    """A number for each word of a text, equal words having the same, and the characters in words."""
    found = _WORD.findall(text) if len(text) < LONG else (m.group() for m in _WORD.finditer(text))
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in found), np.int64)
    size = np.fromiter(map(len, index), np.int64, len(index))
    return ids, int(size[ids].sum()) if len(ids) else 0


def repeated(ids: np.ndarray, span: int = SPAN) -> int:
    """Words in windows of ``span`` words that the text has twice or more."""
    if len(ids) <= span:
        return 0
    # windows of twice the words, numbered by their halves: exact, and a few numbers a word
    width, code = 1, ids
    while width < span:
        step = min(width, span - width)
        pair = code[: len(code) - step] * (int(code.max()) + 1) + code[step:]
        code, width = np.unique(pair, return_inverse=True)[1], width + step
    often = np.bincount(code)[code] > 1
    if not often.any():
        return 0
    covered = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + span, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def distinct(ids: np.ndarray, window: int = WINDOW) -> int:
    """Distinct words of each window of a text, summed."""
    block = np.arange(len(ids)) // window
    return len(np.unique(block * (int(ids.max()) + 1) + ids)) if len(ids) else 0


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct, n_letters, n_upper."""
    text = text or ""
    ids, chars = word_ids(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(ids), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(ids),
        len(lines), distinct(ids), chars - _many(_OTHER, text), _many(_UPPER, text),
    )


def _many(pattern: regex.Pattern, text: str) -> int:
    return len(pattern.findall(text)) if len(text) < LONG else sum(1 for _ in pattern.finditer(text))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_upper")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id and the measures of every row; with ``keep``, those columns too, in a struct ``kept``, but the text as ``text``."""
    other = [c for c in keep if c != text_col]
    names = ["id", *MEASURES, *(["text"] if text_col in keep else []), *(["kept"] if other else [])]

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                rows = np.array([measure(text) for text in piece.column("text").to_pylist()], np.int64).reshape(-1, len(MEASURES))
                yield pa.RecordBatch.from_arrays([piece.column("id"), *(pa.array(c) for c in rows.T), *(piece.column(c) for c in names[1 + len(MEASURES) :])], names=names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *(F.struct(*other).alias("kept") for _ in other[:1]))
    kinds = dict(source.dtypes) | dict.fromkeys(MEASURES, "long")
    return source.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names))


def _share(part: str, whole: str, good: float, bad: float, least: int = 1) -> Column:
    """Good up to one share, bad from another, else abstains; abstains on a whole of less than ``least``."""
    ratio = F.col(part) / F.col(whole)
    return F.when(F.col(whole) < least, ABSTAIN).when(ratio <= good, GOOD).when(ratio >= bad, BAD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The votes, from the measures of a text. Short texts are too small a sample for some; there is no upper length."""
    words, mean = F.col("n_words"), F.col("word_chars") / F.col("n_words")
    distinct, letters = F.col("n_distinct") / F.col("n_words"), F.col("n_letters") / F.col("word_chars")
    return {
        "symbols": _share("n_symbols", "n_words", 0.02, 0.1),
        "repeated_lines": _share("n_dup_lines", "n_lines", 0.0, 0.1, least=3),
        "repeated_words": _share("n_repeat_words", "n_words", 0.0, 0.1),
        "letters": F.when(words == 0, ABSTAIN).when(letters >= 0.95, GOOD).when(letters < 0.9, BAD).otherwise(ABSTAIN),
        "upper_case": _share("n_upper", "n_letters", 0.04, 0.2),
        "word_length": F.when(words < 50, ABSTAIN).when(mean.between(4.4, 6), GOOD).when((mean < 4.3) | (mean > 6.5), BAD).otherwise(ABSTAIN),
        "variety": F.when(words < 50, ABSTAIN).when(distinct >= 0.6, GOOD).when(distinct < 0.55, BAD).otherwise(ABSTAIN),
        "length": F.when(words < 50, BAD).when(words >= 100, GOOD).otherwise(ABSTAIN),
    }


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, np.ndarray]:
    """Posterior of good for each row of votes, the share of good, and P(vote | class) as [rule, class, vote].

    ``counts``: how many texts vote like that. Whether a rule abstains tells nothing. The
    rounds start from what is believed, which settles which class is which.
    """
    vote = np.stack([votes == v for v in (BAD, GOOD)], 2).astype(float)  # row, rule, vote
    belief = np.empty((votes.shape[1], 2, 2))
    for k in (BAD, GOOD):
        belief[:, k] = BAD_VOTES[k], 1 - BAD_VOTES[k]
    likely, share = belief, SHARE
    for _ in range(rounds):
        odds = np.log(share) - np.log1p(-share) + np.einsum("rjv,jv->r", vote, np.log(likely[:, GOOD]) - np.log(likely[:, BAD]))
        good = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        share = float(((counts * good).sum() + TEXTS * SHARE) / (counts.sum() + TEXTS))
        likely = np.empty_like(belief)
        for k, weight in ((GOOD, counts * good), (BAD, counts * (1 - good))):
            sums = np.einsum("r,rjv->jv", weight, vote) + TEXTS * belief[:, k]
            likely[:, k] = sums / sums.sum(1, keepdims=True)
    return good, share, likely


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The measures of every row, base_failed, quality (posterior) and kept; with ``keep``, those columns of the row instead of the measures."""
    measured = measures(docs, id_col, text_col, keep)
    if not keep:
        measured = cut(measured, "measures")
    # with columns to keep, measuring twice is cheaper than writing the texts down
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    voted = measured.withColumns({"votes": F.concat(*(v.cast("string") for v in rules().values())), "base_failed": failed})
    with small_batches(docs.sparkSession):
        seen = voted.groupBy("votes").agg(F.count_if(~F.col("base_failed")).alias("n")).collect()  # one row a combination
    votes = np.array([[int(c) for c in row["votes"]] for row in seen], int).reshape(-1, len(rules()))
    posterior, _, _ = estimate(votes, np.array([row["n"] for row in seen], float)) if seen else (np.zeros(0), 0, None)
    table = docs.sparkSession.createDataFrame([(row["votes"], float(p)) for row, p in zip(seen, posterior)], "votes string, quality double")
    out = voted.join(F.broadcast(table), "votes", "left")
    out = out.withColumn("kept_", ~F.col("base_failed") & (F.coalesce("quality", F.lit(0.0)) >= KEEP))
    if not keep:
        return out.select(F.col("id").alias(id_col), *MEASURES, "base_failed", "quality", F.col("kept_").alias("kept"))
    own = [F.col("text").alias(c) if c == text_col else F.col(f"kept.`{c}`").alias(c) for c in keep]
    return out.select(*own, "base_failed", "quality", F.col("kept_").alias("kept"))
