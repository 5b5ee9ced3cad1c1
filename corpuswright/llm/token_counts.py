"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Each Python worker keeps the counts of the pre-tokens that it has met. The new ones of a batch form a trie that is walked
depth first, in sorted order; every node's forward score (the best log-probability of any segmentation that ends there) is
computed once for all words that share the prefix, from the nodes above it, and terminal nodes store the best path's count.
Only the path from the root to the current node is in memory.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame

from .common import text_rows, worker_state

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE_LETTERS = 6_000_000  # of the words whose counts a worker keeps


def known_counts(words: set[str], path: str) -> dict[str, tuple[int, float]]:
    """The counts that this Python worker keeps for a model, with those of `words`."""
    state = worker_state(("token counts", path), lambda: {"counts": {}, "letters": 0})
    known = state["counts"]
    new = words - known.keys()
    if state["letters"] + sum(map(len, new)) > CACHE_LETTERS:
        known.clear()
        state["letters"], new = 0, words
    state["letters"] += sum(map(len, new))
    known.update((w[1:], v) for w, v in trie_counts([SPACE + w for w in new], path).items())
    return known


@lru_cache(maxsize=2)
def unigram_pieces(path: str) -> tuple[dict[str, float], int, float]:
    """Log-probability of each ordinary piece of the vocabulary file, the longest piece, and the log-probability of a byte.

    Tokenizers are given, not trained, and the file at hand ranks its pieces without probabilities; so rank r has the Zipf
    probability 1 / (r + 1), normalised. A character that is no piece is spelt in bytes, each as likely as the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    norm = math.log(sum(1 / (r + 1) for r in range(len(names))))
    scores = {name: -math.log(r + 1) - norm for r, name in enumerate(names)}
    return scores, max(map(len, names), default=1), -math.log(len(names) + 1) - norm


def trie_counts(words: list[str], path: str) -> dict[str, tuple[int, float]]:
    """(tokens, log-probability) of the best segmentation of each distinct word.

    Of equally likely segmentations the one whose last differing piece is longest counts. Words come sorted, so the trie is
    walked depth first: the path to the current node is all that is in memory, and a shared prefix is scored once.
    """
    scores, longest, byte = unigram_pieces(path)
    get = scores.get
    best, count = [0.0], [0]  # forward score and pieces of each node on the path; the root is the empty prefix
    previous, out = "", {}
    for word in sorted(words):
        depth = 0
        for a, b in zip(previous, word):
            if a != b:
                break
            depth += 1
        del best[depth + 1 :], count[depth + 1 :]
        for end in range(depth + 1, len(word) + 1):
            n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top = best[end - 1] + byte * n_bytes if get(word[end - 1]) is None else -math.inf
            pieces = count[end - 1] + n_bytes
            for begin in range(end - 1, max(-1, end - longest - 1), -1):
                s = get(word[begin:end])
                if s is not None and best[begin] + s >= top:
                    top, pieces = best[begin] + s, count[begin] + 1
            best.append(top)
            count.append(pieces)
        out[word] = (count[-1], best[-1])
        previous = word
    return out


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, log_prob of every whole text; a pre-token is a white-space-delimited word with its mark.

    Null and empty texts have zero tokens and log_prob 0. Rows are scored where they lie and nothing shuffles; repeated rows
    give a row each. A worker's cache of words is emptied when it reaches CACHE_LETTERS, which changes time, not results.
    """
    path = path or public_tokenizers.path(MODEL)

    def run(batches):
        for b in batches:
            ids, texts = b["doc_id"].tolist(), b["text"].tolist()
            for lo in range(0, len(texts), 500):
                split = [t.split() for t in texts[lo : lo + 500]]
                known = known_counts(set().union(*split), path)
                rows = []
                for doc_id, words in zip(ids[lo : lo + 500], split):
                    found = list(map(known.__getitem__, words))
                    rows.append((doc_id, len(words), sum(n for n, _ in found), math.fsum(s for _, s in found)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_pretokens", "n_tokens", "log_prob"])

    return text_rows(docs).mapInPandas(run, "doc_id long, n_pretokens long, n_tokens long, log_prob double")
