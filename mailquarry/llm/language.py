"""Language identification with interpolated Kneser-Ney character models.

Every language has a character model of order ``ORDER`` over words (letters and marks, lower case,
padded at both ends). Spark counts the n-grams of all learning texts; the smoothed models of all
languages are then joined to one sorted array of 64-bit n-gram hashes for each order, with one
log probability for each language. A text gets the language of lowest cross-entropy per
character. Texts whose cross-entropy lies above what calibration texts of that language show are
rejected.

Cases: a null text, an empty text or one without a letter gets ``und``, score 0, and is rejected.
Ties go to the language first in sort order. Repeated rows are counted and answered as often as
they occur. Without any learning text every answer is ``und`` with score 0, and only texts without
a letter are rejected. Extra columns pass through; the columns this operator adds replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailquarry.llm.common import crc_fold, in_arrow, list_offsets, mixed, slices, sums_by_row, texts_of, with_fields
from mailquarry.sinks.facts import staged

ORDER = 4
#: Share of calibration texts of a language that may be rejected, and slack on top of their limit.
FALSE_REJECTION, SLACK = 1e-4, 2.0
#: Characters beyond which a longer text doesn't make the mean more certain.
CERTAIN_CHARS = 256
#: Nats per character between languages are multiplied by this before they become a score.
SHARPNESS = 10.0
UNKNOWN = "und"
PAD, END = "\x02", " "


@dataclass
class Model:
    """Sorted hash arrays by order, and the limits of rejection by language."""

    languages: list[str] = field(default_factory=list)
    keys: list[np.ndarray] = field(default_factory=list)
    log_p: list[np.ndarray] = field(default_factory=list)
    context_keys: list[np.ndarray] = field(default_factory=list)
    log_backoff: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    limit: np.ndarray | None = None


def hashed(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of code points."""
    keys = np.zeros(codes.shape[0], dtype=np.uint64)
    for column in range(codes.shape[1]):
        keys = keys * np.uint64(0x100000001B3) + codes[:, column].astype(np.uint64) + np.uint64(1)
    return mixed(keys)


@dataclass
class Pieces:
    """The distinct white-space separated pieces of some texts, and where they stand."""

    offsets: np.ndarray  # of each text into index
    index: np.ndarray  # distinct piece at each place
    letters: np.ndarray  # whether a distinct piece has a letter
    codes: np.ndarray  # n-grams of all distinct pieces, a row each
    owner: np.ndarray  # distinct piece of each n-gram
    size: np.ndarray  # n-grams of each distinct piece


def pieces_of(texts: pa.Array, order: int = ORDER) -> Pieces:
    """Cuts texts into pieces and their padded n-grams."""
    lists = pc.utf8_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    plain = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), pattern=r"[^\p{L}\p{M}]+", replacement=END)
    plain = pc.utf8_trim(plain, characters=END)
    padded = pc.replace_substring(plain, pattern=END, replacement=END + PAD * (order - 1))
    filled = pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0
    padded = pc.if_else(pa.array(filled), pc.binary_join_element_wise(PAD * (order - 1), padded, END, ""), "")
    chars = np.frombuffer("".join(padded.to_pylist()).encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(padded)), pc.utf8_length(padded).to_numpy(zero_copy_only=False))
    if len(chars) >= order:
        real = np.flatnonzero(chars[order - 1:] != ord(PAD))
        codes = np.lib.stride_tricks.sliding_window_view(chars, order)[real]
        owner = owner[real + order - 1]
    else:
        codes, owner = np.zeros((0, order), dtype=np.uint32), np.zeros(0, dtype=np.int64)
    return Pieces(
        list_offsets(lists), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        pc.match_substring_regex(coded.dictionary, r"\p{L}").to_numpy(zero_copy_only=False),
        codes, owner, np.bincount(owner, minlength=len(padded)),
    )


def _merged(keys: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
    return keys, codes[first], np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts by language of a partition."""
    found: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            pieces = pieces_of(texts_of(part))
            keys = hashed(pieces.codes)
            langs = part.column("lang").dictionary_encode()
            of_place = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(pieces.offsets))
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                weights = np.bincount(pieces.index[of_place == code], minlength=len(pieces.size))[pieces.owner]
                used = weights > 0
                kept = found.setdefault(lang, [])
                kept.append(_merged(keys[used], pieces.codes[used], weights[used]))
                if len(kept) >= 8:
                    kept[:] = [_merged(*(np.concatenate(x) for x in zip(*kept, strict=True)))]
    for lang, kept in found.items():
        _, codes, counts = _merged(*(np.concatenate(x) for x in zip(*kept, strict=True)))
        text = np.ascontiguousarray(codes).astype("<u4").tobytes().decode("utf-32-le")
        grams = [text[i: i + ORDER] for i in range(0, len(text), ORDER)]
        for start in range(0, len(grams), 100_000):
            some = slice(start, start + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams[some]), pa.string()), pa.array(grams[some], pa.string()), pa.array(counts[some], pa.int64())],
                names=["lang", "gram", "n"])


def ngram_counts(learning: DataFrame) -> DataFrame:
    """(lang, gram, n) of all rows (lang, text); rows without a language are left out."""
    rows = learning.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return in_arrow(rows, _count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def smooth(languages: list[str], lang: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> Model:
    """Interpolated Kneser-Ney models of all languages from their n-grams of the highest order.

    Lower orders count distinct left neighbours; n-grams that start with padding have none and keep
    their counts. The discount of an order is n1 / (n1 + 2 n2).
    """
    order = codes.shape[1]
    types: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by order from 1, by language
    for code in range(len(languages)):
        rows, n = codes[lang == code], counts[lang == code].astype(np.float64)
        down = [(rows, n)]
        for _ in range(order - 1):
            suffix = rows[:, 1:]
            weight = np.where(suffix[:, 0] == ord(PAD), n, 1.0)
            keys, first, place = np.unique(hashed(suffix), return_index=True, return_inverse=True)
            rows, n = suffix[first], np.bincount(place, weights=weight, minlength=len(keys))
            down.append((rows, n))
        types.append(down[::-1])
    model = Model(languages=languages)
    alphabet = len(np.unique(np.concatenate([t[0][0][:, 0] for t in types]))) + 1
    below_keys = below = None
    for n_order in range(1, order + 1):
        level = [t[n_order - 1] for t in types]
        all_rows = np.concatenate([rows for rows, _ in level])
        keys, first = np.unique(hashed(all_rows), return_index=True)
        rows = all_rows[first]
        contexts = np.unique(hashed(rows[:, :-1])) if n_order > 1 else np.zeros(1, dtype=np.uint64)
        backoff = np.ones((len(contexts), len(languages)))
        own = np.zeros((len(keys), len(languages)))
        for code, (mine, n) in enumerate(level):
            once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = np.searchsorted(contexts, hashed(mine[:, :-1])) if n_order > 1 else np.zeros(len(mine), dtype=np.int64)
            total = np.bincount(context, weights=n, minlength=len(contexts))
            distinct = np.bincount(context, minlength=len(contexts))
            seen = total > 0
            backoff[seen, code] = discount * distinct[seen] / total[seen]
            own[np.searchsorted(keys, hashed(mine)), code] = np.maximum(n - discount, 0) / total[context]
        if n_order == 1:
            model.unseen = np.log(backoff[0] / alphabet)
            p = own + backoff[0] / alphabet
        else:
            suffixes = np.searchsorted(below_keys, hashed(rows[:, 1:]))
            p = own + backoff[np.searchsorted(contexts, hashed(rows[:, :-1]))] * below[suffixes]
        below_keys, below = keys, p
        model.keys.append(keys)
        model.log_p.append(np.log(p).astype(np.float32))
        model.context_keys.append(contexts)
        model.log_backoff.append(np.log(backoff).astype(np.float32))
    return model


def fitted(learning: DataFrame) -> Model:
    """The model of rows (lang, text), of every language and every n-gram; it takes about 60 bytes an n-gram and 4 a language."""
    counts = staged(ngram_counts(learning), "llm-ngrams")
    rows = counts.toArrow()
    if rows.num_rows == 0:
        return Model()
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    languages = sorted(names)
    lang = np.array([languages.index(x) for x in names])[coded.indices.to_numpy(zero_copy_only=False)]
    chars = np.frombuffer("".join(rows.column("gram").to_pylist()).encode("utf-32-le"), dtype="<u4").reshape(-1, ORDER)
    return smooth(languages, lang, chars, rows.column("n").to_numpy())


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return place, keys[place] == wanted


def log_probabilities(model: Model, codes: np.ndarray) -> np.ndarray:
    """Log probability of the last character of each n-gram in each language."""
    out = np.zeros((len(codes), len(model.languages)), dtype=np.float32)
    open_rows = np.arange(len(codes))
    for n_order in range(len(model.keys), 0, -1):
        tail = codes[open_rows, codes.shape[1] - n_order:]
        place, hit = _found(model.keys[n_order - 1], hashed(tail))
        out[open_rows[hit]] += model.log_p[n_order - 1][place[hit]]
        open_rows, tail = open_rows[~hit], tail[~hit]
        if n_order == 1:
            out[open_rows] += model.unseen
        elif len(open_rows):
            place, hit = _found(model.context_keys[n_order - 1], hashed(tail[:, :-1]))
            out[open_rows[hit]] += model.log_backoff[n_order - 1][place[hit]]
    return out


def cross_entropies(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nats per character by language, characters, and whether there is a letter, of each text."""
    pieces = pieces_of(texts)
    letters = sums_by_row(pieces.letters[pieces.index].astype(np.int64), pieces.offsets) > 0
    chars = sums_by_row(pieces.size[pieces.index].astype(np.int64), pieces.offsets)
    own = np.zeros((len(pieces.size), len(model.languages)))
    log_p = log_probabilities(model, pieces.codes)
    for code in range(len(model.languages)):
        own[:, code] = np.bincount(pieces.owner, weights=log_p[:, code], minlength=len(pieces.size))
    total = sums_by_row(own[pieces.index], pieces.offsets)
    return -total / np.maximum(chars, 1)[:, None], chars, letters


def strangeness(model: Model, entropy: np.ndarray, chars: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How far the cross-entropy lies over the usual one of the language, in its own spread."""
    return (entropy - model.mean[code]) * np.sqrt(np.minimum(chars, CERTAIN_CHARS)) / model.spread[code]


def judged(model: Model, texts: pa.Array) -> dict[str, pa.Array]:
    """The added columns for some texts."""
    entropy, chars, letters = cross_entropies(model, texts)
    if not model.languages:
        none = np.zeros(len(texts))
        return {"lang_pred": pa.array([UNKNOWN] * len(texts)), "score": pa.array(none), "cross_entropy": pa.nulls(len(texts), pa.float64()), "rejected": pa.array(~letters)}
    best = np.argmin(entropy, axis=1)
    lowest = entropy[np.arange(len(best)), best]
    score = np.where(letters, 1 / np.exp(np.minimum((lowest[:, None] - entropy) * SHARPNESS, 0)).sum(axis=1), 0.0)
    odd = strangeness(model, lowest, chars, best) > model.limit[best] if model.limit is not None else np.zeros(len(best), dtype=bool)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    return {
        "lang_pred": pa.array(names[np.where(letters, best, len(model.languages))], pa.string()), "score": pa.array(score),
        "cross_entropy": pa.array(lowest, mask=~letters), "rejected": pa.array(odd | ~letters),
    }


ADDED = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType()))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (of its columns ``keep``, else all) with language, score, cross-entropy and rejection."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs.schema if keep is None else docs.select(keep).schema, *ADDED)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                new = judged(sent.value, texts_of(part))
                yield pa.RecordBatch.from_arrays([new[n] if n in new else part.column(n) for n in names], names=names)

    return in_arrow(docs, run, schema)


def calibrated(model: Model, labelled: DataFrame, false_rejection: float = FALSE_REJECTION) -> Model:
    """Sets the limits of rejection from rows (lang, text) that the model hasn't learned from.

    The spread of a language is measured per character; the limit is the quantile that
    ``false_rejection`` of its texts exceed, times ``SLACK``. Languages without rows take the
    widest limit of the others.
    """
    if not model.languages:
        return model
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                entropy, chars, letters = cross_entropies(sent.value, texts_of(part))
                code = pc.index_in(part.column("lang"), pa.array(sent.value.languages)).to_numpy(zero_copy_only=False)
                use = letters & ~np.isnan(code.astype(np.float64))
                code = code[use].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(entropy[use, code]), pa.array(chars[use])], names=["code", "entropy", "chars"])

    rows = labelled.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    scored = staged(in_arrow(rows, run, "code long, entropy double, chars long"), "llm-calibration")
    mean, spread = F.sum(F.col("entropy") * F.col("chars")) / F.sum("chars"), F.least("chars", F.lit(CERTAIN_CHARS))
    first = scored.groupBy("code").agg(mean.alias("mean")).collect()
    size = len(model.languages)
    model.mean, model.spread, model.limit = np.zeros(size), np.ones(size), np.full(size, np.inf)
    for row in first:
        model.mean[row["code"]] = row["mean"]
    centre = F.element_at(F.array(*[F.lit(float(x)) for x in model.mean]), F.col("code").cast("int") + 1)
    away = scored.withColumn("z", (F.col("entropy") - centre) * F.sqrt(spread))
    for row in away.groupBy("code").agg(F.sqrt(F.avg(F.col("z") * F.col("z"))).alias("spread"), F.percentile_approx("z", 1 - false_rejection, 100_000).alias("limit"), F.max("z").alias("most")).collect():
        model.spread[row["code"]] = max(row["spread"], 1e-6)
        model.limit[row["code"]] = max(row["limit"], 0.0) / model.spread[row["code"]] * SLACK
    known = np.isfinite(model.limit)
    if known.any():
        model.limit[~known] = model.limit[known].max()
        model.mean[~known], model.spread[~known] = model.mean[known].mean(), model.spread[known].max()
    return model


def learned(docs: DataFrame, usable: Column | None = None) -> Model:
    """A calibrated model of the rows of ``docs`` with a language, for which ``usable`` holds.

    Rows whose crc32 of the id modulo 8 is 7 calibrate the rejection; all others are counted.
    """
    rows = docs.select("doc_id", "lang", "text")
    if usable is not None:
        rows = rows.where(usable)
    calibrates = crc_fold("doc_id", 8) == 7
    return calibrated(fitted(rows.where(~calibrates)), rows.where(calibrates))
