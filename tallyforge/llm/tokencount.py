"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The best segmentation of a pre-token is the one with the largest sum of log-probabilities. The distinct pre-tokens of a
batch are inserted in a trie, children in order; one depth-first walk computes a node's forward score once from its
ancestors' scores, whatever number of pre-tokens run through it, and terminal nodes store the count of pieces. Texts then sum up
the counts of their pre-tokens. A task keeps the counts it has seen up to ``CACHE`` pre-tokens; that changes no result.

The vocabulary is a file that the caller names (default: the public SentencePiece one). It orders its pieces by merge
rank and has no probabilities, so a Zipf-Mandelbrot law over the ranks stands in: log p = -log(rank + 2.7) - log H. A
character without a piece costs one byte piece for each of its UTF-8 bytes. Ties go to fewer pieces.

Defined results: null and empty texts have no pre-tokens and no tokens; repeated rows and null ids each give a row;
an empty table gives an empty table; extra columns pass through, except that one named as a result gives way to it.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.textops import append_from_texts
from tallyforge.plans.registry import table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CACHE = 1_000_000
MARK = "▁"
_END = ""


class UnigramTrie:
    """A piece table with scores, and the shared forward pass over a trie of pre-tokens."""

    def __init__(self, ranked: list[str], byte_pieces: int = 256) -> None:
        total = math.log(sum(1 / (r + 2.7) for r in range(1, len(ranked) + byte_pieces + 1)))
        self.scores = {piece: -math.log(r + 2.7) - total for r, piece in enumerate(ranked, 1)}
        self.byte_score = -math.log(len(ranked) + byte_pieces + 2.7) - total
        self.longest = max(map(len, self.scores), default=1)

    def counts(self, words: list[str]) -> dict[str, int]:
        """The number of pieces of every distinct word."""
        root: dict = {}
        for word in words:
            node = root
            for ch in word:
                node = node.setdefault(ch, {})
            node[_END] = True
        found: dict[str, int] = {}
        scores, longest, byte_score = self.scores, self.longest, self.byte_score
        best: list[tuple[float, int]] = [(0.0, 0)]
        stack = [(root, "")]
        while stack:
            node, path = stack.pop()
            j = len(path)
            if j:
                del best[j:]
                width = len(path[-1].encode("utf-8", "surrogatepass"))
                before = best[j - 1]
                top = (before[0] + width * byte_score, before[1] - width)
                for i in range(max(0, j - longest), j):
                    s = scores.get(path[i:])
                    if s is not None:
                        at = best[i]
                        way = (at[0] + s, at[1] - 1)
                        if way > top:
                            top = way
                best.append(top)
                if _END in node:
                    found[path] = -top[1]
            for ch, below in node.items():
                if ch != _END:
                    stack.append((below, path + ch))
        return found


@lru_cache(maxsize=2)
def load(vocabulary: str) -> UnigramTrie:
    """The trie's piece table from a SentencePiece model file, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    usable = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return UnigramTrie(usable)


def pre_tokens(text: str | None) -> list[str]:
    """Runs without ASCII white space, each with the word mark in front."""
    raw = (text or "").encode("utf-8", "surrogatepass").split()
    return [MARK + w.decode("utf-8", "surrogatepass") for w in raw]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """docs without text, and n_pretokens and n_tokens."""
    seen: dict[str, int] = {}

    def compute(texts: list[str | None]) -> list[list]:
        trie = load(vocabulary)
        words = [pre_tokens(t) for t in texts]
        new = {w for ws in words for w in ws}.difference(seen)
        fresh = trie.counts(list(new))
        if len(seen) + len(fresh) > CACHE:
            known = {w: seen[w] for ws in words for w in ws if w in seen}
            seen.clear()
            seen.update(known)
        seen.update(fresh)
        return [[len(ws) for ws in words], [sum(map(seen.__getitem__, ws)) for ws in words]]

    return append_from_texts(docs, compute, "n_pretokens bigint, n_tokens bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
