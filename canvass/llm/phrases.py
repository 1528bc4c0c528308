"""Substring dedup with repeated-phrase automata.

Recurring passages are confirmed across all documents (see :mod:`canvass.llm.repeats`). Each part of the
corpus is a shard: an Aho-Corasick automaton is compiled from the passages confirmed for its documents,
and every document of the shard is streamed through it to locate every occurrence.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from canvass.llm.repeats import Hits, Part, WordWindows, covered, with_repeats

_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _compile(word: np.ndarray, hits: Hits, length: int) -> ahocorasick.Automaton | None:
    """Passages as sequences of word numbers; each carries its length and the first document that holds it."""
    if not len(hits.start):
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for a, c, first in zip(hits.start.tolist(), hits.count.tolist(), hits.first.tolist()):
        n = c + length - 1
        automaton.add_word(tuple(word[a : a + n].tolist()), (n, first))
    automaton.make_automaton()
    return automaton


def _finish(length: int):
    def finish(part: Part, hits: Hits) -> pa.RecordBatch:
        word = np.unique(part.tok, return_inverse=True)[1] + 1 if len(part.tok) else part.tok.astype(np.int64)
        # A passage whose first document is the greatest id here can remove nothing.
        hits = hits.passages()
        useful = hits.first < (part.ids[~part.null].max() if (~part.null).any() else 0)
        automaton = _compile(word, Hits(hits.start[useful], hits.count[useful], hits.first[useful], hits.doc[useful]), length)
        starts, ends = [], []
        for i, (a, b) in enumerate(zip(part.starts.tolist(), part.ends.tolist())):
            if automaton is None or part.null[i] or b - a < length:
                continue
            doc = int(part.ids[i])
            for end, (n, first) in automaton.iter(tuple(word[a:b].tolist())):
                if first < doc:
                    starts.append(a + end - n + 1), ends.append(a + end + 1)
        gone = covered(part, np.array(starts, np.int64), np.array(ends, np.int64))
        n_gone = np.r_[0, np.cumsum(gone)]
        out = []
        for i, (a, b) in enumerate(zip(part.starts.tolist(), part.ends.tolist())):
            kept, spans, n = part.bodies[i].split(), [], int(n_gone[b] - n_gone[a])
            if n:
                kept = compress(kept, (~gone[a:b]).tolist())
                edge = np.flatnonzero(np.diff(np.r_[0, gone[a:b].astype(np.int8), 0])).tolist()
                spans = [{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2])]
            out.append((None if part.null[i] else int(part.ids[i]), b - a, n, hashlib.sha256(b" ".join(kept)).hexdigest(), spans))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return finish


def locate_phrases(docs: DataFrame, length: int = 13, **sizes: int) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, spans (removed word runs, end exclusive).

    A word goes if a window of ``length`` words that covers it also starts in a document with a smaller
    doc_id, judged on the input. Words are compared unchanged. Null texts have no words; rows that repeat
    a doc_id are rows each and do not remove each other; a null doc_id loses and removes nothing.
    """
    return with_repeats(docs, WordWindows(length=length, gram=min(5, length)), _finish(length), _RESULT, **sizes)


def phrase_report(docs: DataFrame) -> DataFrame:
    return locate_phrases(docs).drop("spans")
