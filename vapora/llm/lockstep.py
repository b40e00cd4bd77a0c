"""Automata run over many texts at once: one numpy step moves every text by one symbol."""

from __future__ import annotations

import numpy as np


def segments(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid end to end, cut every `size` symbols: the text, the start and the length of each segment."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]] if len(lengths) else np.zeros(0, np.int64)
    pieces = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), pieces)
    k = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = starts[text] + k * size
    return text, begin, np.minimum(size, starts[text] + lengths[text] - begin)


def run(data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, following: np.ndarray, value: np.ndarray, symbols: int, first: np.ndarray) -> np.ndarray:
    """Sums of value[state, symbol] for every segment and automaton.

    following and value are flat tables of all automata's states; first has each automaton's first state.
    """
    return run_from(np.repeat(first[:, None], len(begin), axis=1), data, begin, lengths, following, value, symbols)[0]


def run_from(states: np.ndarray, data: np.ndarray, begin: np.ndarray, lengths: np.ndarray, following: np.ndarray, value: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """run() from a state for every automaton and segment, and the states at the segments' ends.

    data has the symbols, a row for each automaton or one for all.
    """
    data = np.atleast_2d(data)
    order = np.argsort(-lengths, kind="stable")
    at, sizes, state = begin[order].copy(), lengths[order], states[:, order]
    total = np.zeros(state.shape, value.dtype)
    ends = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    for k in ends:  # the segments that go on
        cell = state[:, :k] * symbols + data[:, at[:k]]
        total[:, :k] += value[cell]
        state[:, :k] = following[cell]
        at[:k] += 1
    sums, out = np.empty_like(total), np.empty_like(state)
    sums[:, order], out[:, order] = total, state
    return sums, out


def run_texts(lengths: np.ndarray, size: int, data: np.ndarray, following: np.ndarray, value: np.ndarray, symbols: int, first: np.ndarray) -> np.ndarray:
    """Sums for every automaton and text of texts laid end to end, as if each text were run in one go.

    Segments first start as if texts began there; those that turn out to begin in another state are run again from that, until
    every segment has begun where its predecessor ended.
    """
    text, begin, sizes = segments(lengths, size)
    starts = np.repeat(first[:, None], len(text), axis=1)
    sums, ends = run_from(starts, data, begin, sizes, following, value, symbols)
    inner = np.flatnonzero(np.r_[False, text[1:] == text[:-1]][: len(text)])
    while len(inner):
        again = inner[(ends[:, inner - 1] != starts[:, inner]).any(axis=0)]
        if not len(again):
            break
        starts[:, again] = ends[:, again - 1]
        sums[:, again], ends[:, again] = run_from(starts[:, again], data, begin[again], sizes[again], following, value, symbols)
    return np.stack([np.bincount(text, weights=s, minlength=len(lengths)) for s in sums])
