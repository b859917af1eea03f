"""Decoders and likelihoods over per-frame scores, for Arrow UDFs over one row's matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(-1, keepdims=True))


def log_add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def prefix_beam(log_probs: np.ndarray, beam: int = 100, blank: int = 0, prune: float | None = None, stay: float = 0.0, advance: float = 0.0) -> tuple[tuple[int, ...], float]:
    """The labelling of most probability by prefix beam search; ties go to the smaller label tuple.

    prune: labels further than this below a frame's best are not tried there, except the blank; None or 0 tries the
    2 * beam best. stay and advance are log-priors of repeating a label and of adding one.
    """
    never = -math.inf
    beams: dict[tuple, tuple[float, float]] = {(): (0.0, never)}
    for frame in log_probs:
        if not prune:
            used = np.argsort(-frame, kind="stable")[: max(2 * beam, 1)]
        else:
            used = np.flatnonzero(frame.max() - frame <= prune)
        picked = [(c, float(frame[c])) for c in sorted({*used.tolist(), blank}) if c == blank or frame[c] > never]
        new: dict[tuple, list[float]] = {}
        for prefix, (pb, pn) in beams.items():
            both = log_add(pb, pn)
            for c, p in picked:
                if c == blank:
                    e = new.setdefault(prefix, [never, never])
                    e[0] = log_add(e[0], both + p)
                    continue
                e = new.setdefault((*prefix, c), [never, never])
                if prefix and prefix[-1] == c:
                    e[1] = log_add(e[1], pb + p + advance)
                    s = new.setdefault(prefix, [never, never])
                    s[1] = log_add(s[1], pn + p + stay)
                else:
                    e[1] = log_add(e[1], both + p + advance)
        order = sorted(((-log_add(*v), k) for k, v in new.items()))[:beam]
        beams = {k: tuple(new[k]) for _, k in order}
    best, v = next(iter(beams.items()))
    return best, log_add(*v)


def ctc_nll(log_probs: np.ndarray, labels: list[int], blank: int = 0) -> float:
    """Negative log-likelihood of a labelling by the forward algorithm; infinite if the frames are too few."""
    ext = [blank]
    for x in labels:
        ext += [x, blank]
    a = np.full(len(ext), -np.inf)
    a[:2] = log_probs[0, ext[:2]]
    skip = np.array([i > 1 and ext[i] != blank and ext[i] != ext[i - 2] for i in range(len(ext))])
    for frame in log_probs[1:]:
        b = np.logaddexp(a, np.concatenate([[-np.inf], a[:-1]]))
        b = np.where(skip, np.logaddexp(b, np.concatenate([[-np.inf, -np.inf], a[:-2]])[: len(a)]), b)
        a = b + frame[ext]
    return -float(np.logaddexp(a[-1], a[-2]) if len(ext) > 1 else a[-1])


def viterbi(emissions: np.ndarray, transition: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[list[int], float]:
    """The state path of most score; ties go to the smaller state."""
    score = emissions[0] + (0 if first is None else first)
    back = []
    for frame in emissions[1:]:
        both = score[:, None] + transition
        back.append(both.argmax(0))
        score = both.max(0) + frame
    if last is not None:
        score = score + last
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], float(score.max())


#: Rows that are advanced together; a batch's tables have rows x frames x states cells.
TOGETHER = 256


def _together(rows: list[np.ndarray], width: int):
    """Batches of rows of like length: (their places, frames of each, scores padded to (rows, frames, width)), longest first."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    for at in range(0, len(order), TOGETHER):
        places = order[at : at + TOGETHER]
        frames = np.array([len(rows[i]) for i in places])
        scores = np.zeros((len(places), int(frames[0]), width))
        for k, i in enumerate(places):
            scores[k, : frames[k]] = rows[i]
        yield places, frames, scores


def ctc_nll_many(rows: list[np.ndarray], labels: list[list[int]], blank: int = 0) -> list[float]:
    """ctc_nll() of many rows, frame after frame of all of them at once."""
    out = [0.0] * len(rows)
    for places, frames, scores in _together(rows, rows[0].shape[1] if rows else 1):
        most = 2 * max(len(labels[i]) for i in places) + 1
        ext = np.full((len(places), most), blank)
        for k, i in enumerate(places):
            ext[k, 1 : 2 * len(labels[i]) : 2] = labels[i]
        last = np.array([2 * len(labels[i]) for i in places])
        skip = np.zeros(ext.shape, bool)
        skip[:, 2:] = (ext[:, 2:] != blank) & (ext[:, 2:] != ext[:, :-2])
        a = np.full(ext.shape, -np.inf)
        a[:, :2] = np.take_along_axis(scores[:, 0], ext[:, :2], 1)
        for t in range(1, scores.shape[1]):
            n = int(np.searchsorted(-frames, -t))  # rows with a frame t
            b = a[:n].copy()
            b[:, 1:] = np.logaddexp(b[:, 1:], a[:n, :-1])
            if most > 2:
                b[:, 2:] = np.where(skip[:n, 2:], np.logaddexp(b[:, 2:], a[:n, :-2]), b[:, 2:])
            a[:n] = b + np.take_along_axis(scores[:n, t], ext[:n], 1)
        each = np.arange(len(places))
        ends = np.where(last > 0, np.logaddexp(a[each, last], a[each, last - 1]), a[each, last])
        for i, x in zip(places, ends, strict=True):
            out[i] = -float(x)
    return out


def viterbi_many(rows: list[np.ndarray], transition: np.ndarray, first: np.ndarray | None = None) -> list[tuple[list[int], float]]:
    """viterbi() of many rows, frame after frame of all of them at once."""
    out: list = [None] * len(rows)
    for places, frames, scores in _together(rows, len(transition)):
        score = scores[:, 0] + (0 if first is None else first)
        back = np.zeros(scores.shape, np.int64)
        for t in range(1, scores.shape[1]):
            n = int(np.searchsorted(-frames, -t))
            both = score[:n, :, None] + transition
            back[:n, t] = both.argmax(1)
            score[:n] = both.max(1) + scores[:n, t]
        state, best = score.argmax(1), score.max(1)
        path = np.zeros(scores.shape[:2], np.int64)
        for t in range(scores.shape[1] - 1, -1, -1):
            n = int(np.searchsorted(-frames, -t))
            path[:n, t] = state[:n]
            state[:n] = back[np.arange(n), t, state[:n]]
        for k, i in enumerate(places):
            out[i] = (path[k, : frames[k]].tolist(), float(best[k]))
    return out


def enter_extend_runs(states: list[int], letters: str = "ACGT") -> tuple[str, list[int]]:
    """Runs of an enter/extend path (0-3 begin a letter, 4-7 prolong it): collapsed letters and their frames."""
    out, frames = [], []
    for s in states:
        if s < 4 or not out or out[-1] != letters[s - 4]:
            out.append(letters[s % 4])
            frames.append(1)
        else:
            frames[-1] += 1
    return "".join(out), frames


def fitted_runs(bases: list[int], chars: list[int] | None = None, frames: list[int] | None = None, tokens: list[int] | None = None, letters: str = "ACGT") -> dict:
    """Runs of a decoder made whole: bases from tokens (neighbours apart) where there are none, lengths cut or filled up with 1."""
    if not bases and tokens:
        bases = [t for i, t in enumerate(tokens) if not i or t != tokens[i - 1]]
    n = len(bases)
    fill = lambda x: [*x, *[1] * n][:n]
    chars = fill(chars or [])
    frames = fill(frames) if frames else [max(x, 1) for x in chars]
    name = lambda b: letters[b - 1] if 1 <= b <= len(letters) else "N"
    return {
        "collapsed": "".join(map(name, bases)), "expanded": "".join(name(b) * max(c, 1) for b, c in zip(bases, chars, strict=True)),
        "collapsed_length": n, "expanded_length": sum(max(c, 1) for c in chars), "char_runs": chars, "frame_runs": frames,
    }


def _matrix(x, width: int) -> np.ndarray:
    return np.asarray(x, float).reshape(-1, width)


def _has(x) -> bool:
    return x is not None and len(x) > 0


def beam_udf(width: int, letters: str = "ACGT", beam: int = 100, prune: float | None = None, stay: float = 0.0, advance: float = 0.0):
    """A column of flat score arrays (frames x width) -> decoded text and its log-probability; null for null or no frames."""

    def run(flat: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for x in flat:
            if x is None or not len(x):
                rows.append((None, None))
                continue
            best, p = prefix_beam(log_softmax(_matrix(x, width)), beam, 0, prune, stay, advance)
            rows.append(("".join(letters[c - 1] if c <= len(letters) else "N" for c in best), p))
        return pd.DataFrame(rows, columns=["text", "log_prob"])

    return F.pandas_udf(run, "text string, log_prob double")


def ctc_nll_udf(width: int):
    """Columns of flat score arrays and label arrays -> negative log-likelihood; null for nulls or no frames, infinite if the frames are too few."""

    def run(flat: pd.Series, labels: pd.Series) -> pd.Series:
        known = [i for i, (x, y) in enumerate(zip(flat, labels, strict=True)) if _has(x) and y is not None]
        out = pd.Series([None] * len(flat), dtype="float64")
        out.iloc[known] = ctc_nll_many([log_softmax(_matrix(flat.iloc[i], width)) for i in known], [[int(v) for v in labels.iloc[i]] for i in known])
        return out

    return F.pandas_udf(run, "double")


#: States of the enter/extend lattice: 0-3 begin A, C, G, T; 4-7 prolong them. A letter is prolonged or another one begins (the same one too).
ENTER_EXTEND = np.array([[0.0 if b < 4 or b - 4 == a % 4 else -np.inf for b in range(8)] for a in range(8)])


def enter_extend_udf():
    """A column of flat arrays (frames x 8 state scores) -> letters and the frames of each by the best path; a path begins with a letter. Null for null or no frames."""
    first = np.array([0.0] * 4 + [-np.inf] * 4)

    def run(flat: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None, None, None)] * len(flat)
        known = [i for i, x in enumerate(flat) if _has(x)]
        for i, (path, score) in zip(known, viterbi_many([_matrix(flat.iloc[i], 8) for i in known], ENTER_EXTEND, first), strict=True):
            rows[i] = (*enter_extend_runs(path), score)
        return pd.DataFrame(rows, columns=["text", "frames", "score"])

    return F.pandas_udf(run, "text string, frames array<int>, score double")


def crf_nll(emissions: np.ndarray, labels: list[int]) -> float:
    """Log-sum of all enter/extend paths less that of those that spell the labels (0 to 3); infinite if the frames are too few."""
    every = np.where(np.arange(8) < 4, emissions[0], -np.inf)
    own = np.full(len(labels), -np.inf)
    if len(labels):
        own[0] = emissions[0, labels[0]]
    for frame in emissions[1:]:
        every = np.logaddexp.reduce(every[:, None] + ENTER_EXTEND, 0) + frame
        if len(labels):
            begun = np.concatenate([[-np.inf], own[:-1]]) + frame[labels]
            own = np.logaddexp(begun, own + frame[np.asarray(labels) + 4])
    found = own[-1] if len(labels) else -np.inf
    return float("inf") if found == -np.inf else float(np.logaddexp.reduce(every) - found)


def crf_nll_many(rows: list[np.ndarray], labels: list[list[int]]) -> list[float]:
    """crf_nll() of many rows, frame after frame of all of them at once."""
    out = [0.0] * len(rows)
    for places, frames, scores in _together(rows, 8):
        every = np.where(np.arange(8) < 4, scores[:, 0], -np.inf)
        most = max(1, *(len(labels[i]) for i in places))
        spelt = np.zeros((len(places), most), np.int64)
        for k, i in enumerate(places):
            spelt[k, : len(labels[i])] = labels[i]
        own = np.full(spelt.shape, -np.inf)
        own[:, 0] = np.take_along_axis(scores[:, 0], spelt[:, :1], 1)[:, 0]
        for t in range(1, scores.shape[1]):
            n = int(np.searchsorted(-frames, -t))
            every[:n] = np.logaddexp.reduce(every[:n, :, None] + ENTER_EXTEND, 1) + scores[:n, t]
            begun = np.full((n, most), -np.inf)
            begun[:, 1:] = own[:n, :-1]
            own[:n] = np.logaddexp(begun + np.take_along_axis(scores[:n, t], spelt[:n], 1), own[:n] + np.take_along_axis(scores[:n, t], spelt[:n] + 4, 1))
        total = np.logaddexp.reduce(every, 1)
        for k, i in enumerate(places):
            found = own[k, len(labels[i]) - 1] if len(labels[i]) else -np.inf
            out[i] = float("inf") if found == -np.inf else float(total[k] - found)
    return out


def crf_nll_udf():
    """Columns of flat arrays (frames x 8 state scores) and label arrays (0 to 3) -> crf_nll; null for nulls or no frames."""

    def run(flat: pd.Series, labels: pd.Series) -> pd.Series:
        known = [i for i, (x, y) in enumerate(zip(flat, labels, strict=True)) if _has(x) and y is not None]
        out = pd.Series([None] * len(flat), dtype="float64")
        out.iloc[known] = crf_nll_many([_matrix(flat.iloc[i], 8) for i in known], [[int(v) for v in labels.iloc[i]] for i in known])
        return out

    return F.pandas_udf(run, "double")


def predict_udf(load, returns: str = "array<double>"):
    """A column of arrays through a model of the caller's: load() gives, once for each task, a function from a list of arrays to a list of results."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for x in parts:
            yield pd.Series(list(model(x.tolist())), dtype=object)

    return F.pandas_udf(run, returns)


def blank_viterbi_udf(width: int, letters: str = "ACGT"):
    """A column of flat arrays (frames x width, class 0 blank) -> letters and frames of each by the best path, where equal neighbours are one letter and blanks part them."""

    def run(flat: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = [(None, None, None)] * len(flat)
        known = [i for i, x in enumerate(flat) if _has(x)]
        for i, (path, score) in zip(known, viterbi_many([_matrix(flat.iloc[i], width) for i in known], np.zeros((width, width))), strict=True):
            text, frames, last = "", [], 0
            for s in path:
                if s and s == last:
                    frames[-1] += 1
                elif s:
                    text, frames = text + (letters[s - 1] if s <= len(letters) else "N"), [*frames, 1]
                last = s
            rows[i] = (text, frames, score)
        return pd.DataFrame(rows, columns=["text", "frames", "score"])

    return F.pandas_udf(run, "text string, frames array<int>, score double")
