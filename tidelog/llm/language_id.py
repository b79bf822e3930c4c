"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of the vocabulary. The likelihood of a run of letters is the sum over
all its segmentations into pieces of the product of the pieces' probabilities: a forward pass, made for many distinct
runs at once in numpy. Probabilities are learned by expectation-maximisation (forward and backward passes).

Texts are lower-cased and cut into runs of letters; runs of over PART letters are summed in logarithms, since their
products leave the range of doubles. A text's score is the posterior of the best language, all being equally likely
before. Letters outside the vocabulary take a floor probability.

Defined cases: a null text or one without a letter is `und` with score 0; documents with null lang or id are never
learned from; repeated rows are judged one by one; with no learnable language everything is `und`; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import caches
from tidelog.llm.common import crc_mod, settled, table, unit_hash

PART = 32
SAMPLE_CHARS = 4_000_000
CACHE_WORDS = 300_000
_RUN = re.compile(r"[^\W\d_]+")
_B = np.uint64(0x100000001B3)
_state: dict = {}
caches.owner("language", _state.clear)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def letter_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, without word marks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = (sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
    return sorted({p for p in got if p.isalpha() and p == p.lower()})


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words], np.int64)
    m = np.zeros((len(words), int(size.max(initial=1))), np.uint64)
    m[np.arange(m.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return m, size


def _keys(m: np.ndarray, longest: int | None = None) -> list[np.ndarray]:
    """Hashes of all substrings (of at most `longest` letters): element k - 1 has those of length k by start."""
    out, h = [], np.full(m.shape, 14695981039346656037, np.uint64)
    for k in range(1, min(longest or m.shape[1], m.shape[1]) + 1):
        h = (h[:, : m.shape[1] - k + 1] ^ (m[:, k - 1 :] + np.uint64(k))) * _B
        h = h ^ (h >> np.uint64(29))
        out.append(h)
    return out


def _batches(words: list[str]) -> Iterator[list[int]]:
    """Places of the words by length: 4096 at once, fewer where they are over PART letters; these are never with shorter ones."""
    by = sorted(range(len(words)), key=lambda i: len(words[i]))
    lo = 0
    while lo < len(by):
        hi = lo + 1
        while hi < len(by) and hi - lo < 4096 and (len(words[by[hi]]) <= PART or (len(words[by[lo]]) > PART and (hi - lo + 1) * len(words[by[hi]]) <= 4096 * PART)):
            hi += 1
        yield by[lo:hi]
        lo = hi


class PieceModel:
    def __init__(self, pieces: list[str], langs: list[str], probs: np.ndarray | None = None, floor: float = 1e-7):
        self.langs, self.floor = langs, floor
        self.longest = max(map(len, pieces), default=1)
        keys = np.concatenate([_keys(_codes([p])[0])[len(p) - 1].ravel() for p in pieces]) if pieces else np.zeros(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.n = keys[order], len(keys)
        self.probs = np.full((self.n, len(langs)), 1.0 / max(1, self.n)) if probs is None else probs

    def _rows(self) -> np.ndarray:
        """Probabilities with two more rows: the floor for letters outside the vocabulary, and nothing."""
        return np.vstack([self.probs, np.full((1, len(self.langs)), self.floor), np.zeros((1, len(self.langs)))])

    def _ids(self, m: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        out = []
        for k, h in enumerate(_keys(m, self.longest), 1):
            at = np.searchsorted(self.keys, h).clip(max=max(self.n - 1, 0))
            hit = (self.keys[at] == h) if self.n else np.zeros(h.shape, bool)
            ids = np.where(hit, at, self.n if k == 1 else self.n + 1)
            out.append(np.where(np.arange(h.shape[1])[None, :] + k <= size[:, None], ids, self.n + 1))
        return out

    def _forward(self, ids: list[np.ndarray], p: np.ndarray, n: int, length: int) -> np.ndarray:
        a = np.zeros((length + 1, n, len(self.langs)))
        a[0] = 1
        for j in range(1, length + 1):
            for k in range(1, min(j, len(ids)) + 1):
                a[j] += a[j - k] * p[ids[k - 1][:, j - k]]
        return a

    def _log_pass(self, ids: list[np.ndarray], lp: np.ndarray, n: int, length: int) -> np.ndarray:
        """The forward pass in logarithms."""
        a = np.full((length + 1, n, len(self.langs)), -np.inf)
        a[0] = 0
        for j in range(1, length + 1):
            a[j] = np.logaddexp.reduce([a[j - k] + lp[ids[k - 1][:, j - k]] for k in range(1, min(j, len(ids)) + 1)])
        return a

    def log_likelihood(self, words: list[str]) -> np.ndarray:
        """For each run, by language."""
        out = np.zeros((len(words), len(self.langs)))
        p = self._rows()
        with np.errstate(divide="ignore"):
            lp = np.log(p)
        for idx in _batches(words):
            m, size = _codes([words[x] for x in idx])
            ids, n, end = self._ids(m, size), len(idx), (size, np.arange(len(idx)))
            out[idx] = np.log(self._forward(ids, p, n, m.shape[1])[end]) if m.shape[1] <= PART else self._log_pass(ids, lp, n, m.shape[1])[end]
        return out

    def learn(self, counts: list[tuple[str, np.ndarray]], rounds: int = 4, smooth: float = 0.05) -> None:
        """counts: runs with how often each language has them."""
        for _ in range(rounds):
            p, got = self._rows(), np.zeros((self.n + 2, len(self.langs)))
            with np.errstate(divide="ignore"):
                lp = np.log(p)
            for idx in _batches([w for w, _ in counts]):
                part = [counts[i] for i in idx]
                m, size = _codes([w for w, _ in part])
                n, length = m.shape
                ids, end = self._ids(m, size), (size, np.arange(n))
                times = np.array([c for _, c in part])
                if length > PART:
                    a = self._log_pass(ids, lp, n, length)
                    b = np.full_like(a, -np.inf)
                    b[end] = 0
                    for j in range(length - 1, -1, -1):
                        b[j] = np.logaddexp(b[j], np.logaddexp.reduce([b[j + k] + lp[ids[k - 1][:, j]] for k in range(1, min(length - j, len(ids)) + 1)]))
                    share = lambda j, k, at: np.exp(a[j] + lp[at] + b[j + k] - a[end]) * times  # noqa: B023, E731
                else:
                    a = self._forward(ids, p, n, length)
                    b = np.zeros_like(a)
                    b[end] = 1
                    for j in range(length - 1, -1, -1):
                        for k in range(1, min(length - j, len(ids)) + 1):
                            b[j] += b[j + k] * p[ids[k - 1][:, j]]
                    w = times / np.maximum(a[end], 1e-300)
                    share = lambda j, k, at: a[j] * p[at] * b[j + k] * w  # noqa: B023, E731
                for k in range(1, len(ids) + 1):
                    for j in range(length - k + 1):
                        at = ids[k - 1][:, j]
                        use = at < self.n
                        if use.any():
                            np.add.at(got, at[use], share(j, k, at)[use])
            self.probs = (got[: self.n] + smooth) / (got[: self.n].sum(axis=0) + smooth * max(1, self.n))


def runs_of(text: str) -> list[str]:
    """Runs of letters of the lower-cased text."""
    got = _RUN.findall(text.lower())
    if all(map(str.isalpha, got)):
        return got
    return [x for w in got for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def train(docs: DataFrame, condition, vocabulary: str, sample_chars: int = SAMPLE_CHARS) -> PieceModel:
    """Learn from about sample_chars characters, shared equally by the languages and chosen by a hash of the id."""
    known = docs.where(condition & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.sum(F.length("text")).alias("n")).orderBy("lang").collect()}
    langs = sorted(k for k, n in sizes.items() if n)
    pieces = letter_pieces(vocabulary)
    model = PieceModel(pieces, langs)
    if not langs:
        return model
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col("lang") == k, F.lit(min(1.0, sample_chars / len(langs) / sizes[k]))).otherwise(share)
    counts: dict[str, Counter] = {k: Counter() for k in langs}
    for r in known.where(unit_hash("doc_id", seed=7) < share).select("lang", "text").toLocalIterator():
        counts[r["lang"]].update(runs_of(r["text"]))
    words = sorted(set().union(*counts.values()))
    model.learn([(w, np.array([counts[k][w] for k in langs], float)) for w in words])
    return model


def identify(docs: DataFrame, model: PieceModel) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; distinct runs are scored once and kept in a bounded cache."""
    import uuid

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.only("language")
        if _state.get("key") != key:
            _state.update(key=key, at={}, letters=0, rows=np.zeros((1 << 12, len(model.langs))))
        for batch in batches:
            texts = batch.column(1)
            preds, scores = [], []
            for i in range(0, batch.num_rows, 256):
                runs = [runs_of(t) if t else [] for t in texts.slice(i, 256).to_pylist()]
                at = _state["at"]
                new = list({w for r in runs for w in r if w not in at})
                if len(at) + len(new) > CACHE_WORDS or _state["letters"] > CACHE_WORDS * PART:
                    at.clear()
                    _state["letters"] = 0
                    new = list({w for r in runs for w in r})
                if new:
                    need = len(at) + len(new)
                    if need > len(_state["rows"]):
                        _state["rows"] = np.concatenate([_state["rows"], np.zeros((need, len(model.langs)))])
                    _state["rows"][len(at) : need] = model.log_likelihood(new)
                    at.update(zip(new, range(len(at), need), strict=True))
                    _state["letters"] += sum(map(len, new))
                rows = _state["rows"]
                for r in runs:
                    if not r or not model.langs:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    s = rows[list(map(at.__getitem__, r))].sum(axis=0)
                    best = int(s.argmax())
                    preds.append(model.langs[best])
                    scores.append(float(1 / np.exp(s - s[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


@settled
def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_mod("doc_id", 5) != 0, default_vocabulary())
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
