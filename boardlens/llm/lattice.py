"""Unigram subword lattices over words, in batches.

A word is its UTF-8 bytes after one space (the word mark). An edge is a piece of
the vocabulary; the probability of a word is the sum over all segmentations of
the product of their pieces' probabilities, found by a forward recursion in log
space. Words of a batch that are equally long are one matrix, so each step of
the recursion is a numpy operation over all of them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from boardlens.llm import words as W
from boardlens.llm.bpe import KeyTable

#: Longer words take a scalar path.
MAX_MATRIX = 48
_LENGTH = 0xA0761D6478BD642F  # as in words.span_keys


def load_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces as bytes, log prior) of a sentencepiece file.

    Where the file's scores are log-probabilities they are the prior. Files of
    the BPE kind hold merge ranks instead (0, -1, -2, ...): there the prior
    falls as 1 / rank. Single bytes that no piece covers come from the file's
    byte pieces.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    scores = []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i):
            continue
        p = sp.id_to_piece(i)
        mark, rest = p[:1] == "▁", p[1:] if p[:1] == "▁" else p
        if "▁" in rest or any(c.isspace() for c in rest):
            continue
        pieces[(b" " if mark else b"") + rest.encode()] = sp.get_score(i)
        scores.append(sp.get_score(i))
    ranks = scores and min(scores) <= -len(scores) / 2
    low = min(scores, default=0.0)
    for b in range(256):
        pieces.setdefault(bytes([b]), low - 1.0)
    raw = np.array(list(pieces.values()))
    prior = -np.log(10.0 - np.minimum(raw, 0.0)) if ranks else raw
    return list(pieces), prior - np.log(np.exp(prior).sum())


class Lattice:
    """Pieces with their log probabilities (natural logarithm)."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.pieces, self.logp = pieces, np.append(logp, -np.inf)  # the last stands for no piece
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        self.longest = max(len(p) for p in pieces)
        self.table = KeyTable()
        keys = W.span_keys(data, ends - [len(p) for p in pieces], ends)
        self.table.insert(keys, np.arange(len(pieces), dtype=np.int32))
        self.index = {p: i for i, p in enumerate(pieces)}

    def _edges(self, m: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """{(from, to): piece of each row, or -1} of equally long words."""
        n, size = m.shape
        prefix = np.zeros((size + 1, n), np.uint64)
        np.cumsum(((m.astype(np.uint64) + np.uint64(1)) * W._powers("up", size)).T, axis=0, out=prefix[1:])
        down = W._powers("down", size + 1)
        out = {}
        for i in range(size):
            for j in range(i + 1, min(size, i + self.longest) + 1):
                at = self.table.find(W.mix((prefix[j] - prefix[i]) * down[i] + np.uint64((j - i) * _LENGTH % (1 << 64))))
                if j == i + 1 or (at >= 0).any():
                    out[i, j] = at
        return out

    def _forward(self, m: np.ndarray) -> tuple[np.ndarray, dict]:
        edges = self._edges(m)
        alpha = np.full((m.shape[1] + 1, len(m)), -np.inf)
        alpha[0] = 0
        for (i, j), at in sorted(edges.items(), key=lambda e: e[0][1]):
            alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.logp[at])
        return alpha, edges

    def _groups(self, words: list[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray | None]]:
        """(places, matrix) by length; no matrix for the long ones."""
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(size, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if not len(at):
                continue
            n = int(size[at[0]])
            if n > MAX_MATRIX:
                yield at, None
            else:
                yield at, np.frombuffer(b"".join(b" " + words[k] for k in at.tolist()), np.uint8).reshape(len(at), n)

    def _scalar(self, word: bytes) -> tuple[list[float], list[tuple[int, int, int]]]:
        alpha, edges = [0.0], []
        for j in range(1, len(word) + 1):
            total = -np.inf
            for i in range(max(0, j - self.longest), j):
                k = self.index.get(word[i:j])
                if k is not None:
                    edges.append((i, j, k))
                    total = float(np.logaddexp(total, alpha[i] + self.logp[k]))
            alpha.append(total)
        return alpha, edges

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural-log probability of each word, over all its segmentations."""
        out = np.zeros(len(words))
        for at, m in self._groups(words):
            if m is None:
                out[at] = [self._scalar(b" " + words[k])[0][-1] for k in at.tolist()]
            else:
                out[at] = self._forward(m)[0][-1]
        return out

    def expect(self, words: list[bytes], weight: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, times their weights (forward-backward)."""
        total = np.zeros(len(self.pieces) + 1)
        for at, m in self._groups(words):
            if m is None:
                for k in at.tolist():
                    alpha, edges = self._scalar(b" " + words[k])
                    beta = [-np.inf] * len(alpha)
                    beta[-1] = 0.0
                    for i, j, p in sorted(edges, key=lambda e: -e[1]):
                        total[p] += weight[k] * np.exp(alpha[i] + self.logp[p] + beta[j] - alpha[-1])
                        beta[i] = float(np.logaddexp(beta[i], self.logp[p] + beta[j]))
                continue
            alpha, edges = self._forward(m)
            beta = np.full_like(alpha, -np.inf)
            beta[-1] = 0
            for (i, j), e in sorted(edges.items(), key=lambda x: -x[0][1]):
                onward = self.logp[e] + beta[j]
                some = np.flatnonzero(e >= 0)
                np.add.at(total, e[some], weight[at[some]] * np.exp((alpha[i] + onward - alpha[-1])[some]))
                beta[i] = np.logaddexp(beta[i], onward)
        return total[:-1]
