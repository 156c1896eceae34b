"""Byte-pair encoding and decoding by tree concatenation.

A text beyond a leaf's length is cut into leaves, which are encoded on their own in different tasks. Two
neighbours are then joined: the text around the join is encoded again, over a window of a few tokens on
either side, and the window doubles until its first tokens are the left side's and its last the right
side's at the same places. From there on neither side can change: the split into words looks at most
ahead, and a sequence of tokens is the encoding if each pair of neighbours is one. A window that never
agrees ends as the encoding of both sides together, which is exact by definition. Joins go up the tree
in tasks of ``FAN`` neighbours each; the last one has the whole text's tokens, as its row does.

Most texts hold only characters that every version of Unicode classes alike. Their words are split here and
encoded by the tokenizer once each, as it encodes words one by one; other texts go to it whole.

The tokenizer is read from a file whose path is a parameter; nothing is trained.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import with_python

LEAF_CHARS = 16_384
#: Neighbours that one task joins.
FAN = 16
#: Tokens on either side of a join to begin with, and tokens that must agree.
FIRST_WINDOW, AGREE = 16, 4
#: Characters that are encoded in one call, and words that a worker remembers.
CALL_CHARS, WORDS = 400_000, 300_000

#: Characters whose class is beyond doubt: letters, digits, spaces and signs of ASCII, Latin letters, dashes and quotes.
_LETTER, _SPACE = "A-Za-zÀ-ÖØ-öø-ſ", "\\t\\n\\r\\x20"
_SIGN = "!-/:-@\\[-`{-~–—‘’“”…"
_PLAIN = re.compile(f"[{_LETTER}0-9{_SPACE}{_SIGN}]*")
#: The split into words that byte-level tokenizers make, over those characters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[{_SIGN}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class TreeEncoder:
    """Encodes texts leaf by leaf and joins the leaves."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.leaf = leaf_chars
        added = self.tok.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values(), default=0) + 1, dtype=np.int64)
        #: What an id takes between tasks.
        self.kind = np.uint16 if len(self.width) <= 1 << 16 else np.int32
        for token, i in vocab.items():
            # a byte-level token has one character for each byte
            self.width[i] = len(token.encode()) if i in added else len(token)
        self.by_word = self._by_word(path)
        #: The ids of each word that is known, in decimal digits, as the digests want them.
        self.text_of: dict[str, str] = {}
        self.bytes_of = self._bytes(vocab) if self.by_word else {}

    def _by_word(self, path: str) -> bool:
        """Whether the tokenizer splits as ``_SPLIT`` does and encodes each word by itself."""
        with open(path) as f:
            made = json.load(f)
        split, model = made["pre_tokenizer"] or {}, made["model"]
        return (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and (made["decoder"] or {}).get("type") == "ByteLevel" and made["normalizer"] is None and made["post_processor"] is None
            and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        )

    @staticmethod
    def _bytes(vocab: dict[str, int]) -> dict[int, bytes]:
        """Bytes of each token: printable characters stand for themselves, the other bytes for those from 256 on."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
        return {i: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t, i in vocab.items()}

    def words(self, text: str) -> list[str] | None:
        """The words of a text that may be encoded one by one, else None."""
        if not self.by_word or not _PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            return None
        return _SPLIT.findall(text)

    def learn(self, words: list[list[str]]) -> None:
        """Encode the words that aren't known yet, in one call."""
        if len(self.text_of) > WORDS:
            for w in list(islice(self.text_of, WORDS // 2, None)):  # those met first are the frequent ones
                del self.text_of[w]
        new = list(set().union(*words).difference(self.text_of))
        for w, e in zip(new, self.tok.encode_batch_fast(new, add_special_tokens=False)):
            self.text_of[w] = str(e.ids)[1:-1].replace(" ", "")

    def encoded(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """Ids of each text, and the same in decimal digits."""
        split = [self.words(t) for t in texts]
        self.learn([w for w in split if w])
        other = iter(self.tok.encode_batch_fast([t for t, w in zip(texts, split) if w is None], add_special_tokens=False))
        digits = [str(next(other).ids)[1:-1].replace(" ", "") if w is None else ",".join(map(self.text_of.__getitem__, w)) for w in split]
        return [(np.fromstring(d, dtype=np.int32, sep=",") if d else np.zeros(0, dtype=np.int32), d) for d in digits]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids, _ in self.encoded(texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        if self.by_word:
            try:
                return [b"".join(map(self.bytes_of.__getitem__, x)).decode() for x in ids]
            except (KeyError, UnicodeDecodeError):  # parts of characters, or ids beyond the vocabulary
                pass
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def packed(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.kind).tobytes()

    def unpacked(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.kind).astype(np.int64)

    def cuts(self, text: str) -> list[int]:
        """Places to cut a text at, never inside the string of an added token."""
        out = []
        for m in range(self.leaf, len(text), self.leaf):
            moved = True
            while moved:
                moved = False
                for s in self.specials:
                    p = text.find(s, max(0, m - len(s) + 1), m + len(s) - 1)
                    if p != -1 and p < m < p + len(s):
                        m, moved = p, True
            if m > (out[-1] if out else 0):
                out.append(m)
        return out

    def leaves(self, text: str) -> list[str]:
        at = [0, *self.cuts(text), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])]

    def join(self, data: bytes, at: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two neighbours that meet at byte ``at`` of ``data``."""
        j = FIRST_WINDOW
        while True:
            jl, jr = min(j, len(left)), min(j, len(right))
            a = at - int(self.width[left[len(left) - jl :]].sum())
            while jl < len(left) and data[a] & 0xC0 == 0x80:  # a token may begin inside a character
                jl += 1
                a -= int(self.width[left[-jl]])
            b = at + int(self.width[right[:jr]].sum())
            while jr < len(right) and data[b] & 0xC0 == 0x80:
                b += int(self.width[right[jr]])
                jr += 1
            window = self.encoded([data[a:b].decode()])[0][0].astype(np.int64)
            if len(window) >= 2 * AGREE or jl == len(left) or jr == len(right):
                head, tail = left[len(left) - jl :], right[:jr]
                same_head = jl == len(left) or np.array_equal(window[:AGREE], head[:AGREE])
                same_tail = jr == len(right) or np.array_equal(window[-AGREE:], tail[-AGREE:])
                if same_head and same_tail:
                    return np.concatenate([left[: len(left) - jl], window, right[jr:]])
            j *= 2

    def tree(self, texts: list[str], ids: list[np.ndarray]) -> np.ndarray:
        """Join neighbours, of which texts and encodings are given, two by two up to the whole."""
        data = [t.encode() for t in texts]
        begins = np.cumsum([0, *map(len, data)]).tolist()
        whole, parts = b"".join(data), list(zip(begins, ids))
        while len(parts) > 1:
            up = [(a, self.join(whole, m, x, y)) for (a, x), (m, y) in zip(parts[::2], parts[1::2])]
            parts = up + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0][1] if parts else np.zeros(0, dtype=np.int64)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Encodings of texts of any length, with the leaves of all of them in one call."""
        split = [self.leaves(t) for t in texts]
        flat = iter(self.encode([leaf for leaves in split for leaf in leaves]))
        return [self.tree(leaves, [np.array(next(flat), dtype=np.int64) for _ in leaves]).tolist() for leaves in split]

    def results(self, encoded: list[tuple[np.ndarray, str]], keep_ids: bool, keep_text: bool) -> dict[str, list]:
        """Counts and digests of encodings, and of the texts that their ids decode to."""
        texts = self.decode([ids.tolist() for ids, _ in encoded])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out: dict[str, list] = {
            "n_tokens": [len(ids) for ids, _ in encoded],
            "ids_sha256": [sha(digits) for _, digits in encoded],
            "decoded_sha256": [sha(t) for t in texts],
        }
        return out | ({"ids": [ids for ids, _ in encoded]} if keep_ids else {}) | ({"decoded": texts} if keep_text else {})


_encoders: dict[tuple[str, int], TreeEncoder] = {}


def encoder(path: str, leaf_chars: int) -> TreeEncoder:
    """One encoder for each worker process."""
    if (path, leaf_chars) not in _encoders:
        _encoders[path, leaf_chars] = TreeEncoder(path, leaf_chars)
    return _encoders[path, leaf_chars]


def _calls(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``CALL_CHARS`` characters, so that memory is bounded by a call."""
    part: list[str] = []
    n = 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= CALL_CHARS:
            yield part
            part, n = [], 0
    if part:
        yield part


_ARROW = {
    "n_tokens": pa.int64(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
    "ids": pa.list_(pa.int32()),
    "decoded": pa.string(),
}


def encode_documents(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
    keep_text: bool = False,
    leaf_chars: int = LEAF_CHARS,
    fan: int = FAN,
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids][, decoded]): one row per row of ``docs``.

    A null text is empty and has no tokens; an empty table has no rows. Repeated rows are encoded one by one.
    Texts up to a leaf are encoded where they are read; the leaves of the others are dealt out, one by one,
    in a scan of its own, so that short texts are neither shuffled nor written. Columns of ``docs`` other than
    the two named aren't read, so their names don't matter.
    """
    with_python(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    extra = (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_text else "")
    schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{extra}"

    def batch_of(keys: pa.Array, made: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, *[pa.array(v, _ARROW[k]) for k, v in made.items()]], ["doc_id", *made])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf_chars)
        for batch in batches:
            at = 0
            for part in _calls(batch.column("text").to_pylist()):
                yield batch_of(batch.column("doc_id").slice(at, len(part)), enc.results(enc.encoded(part), keep_ids, keep_text))
                at += len(part)

    size = F.length("text")
    short = rows.filter(size <= leaf_chars).mapInArrow(whole, schema)
    longest = rows.agg(F.max(size)).first()[0] or 0
    if longest <= leaf_chars:
        return short

    # a row's key doesn't depend on its place: rows that agree in all of it are the same text
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path, leaf_chars), Counter()
        for batch in batches:
            for i, (th, text) in enumerate(zip(batch.column("th").to_pylist(), batch.column("text").to_pylist())):
                key = (batch.column("doc_id")[i].as_py(), th)
                seen[key] += 1
                for node, leaf in enumerate(enc.leaves(text)):
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).slice(i, 1) for c in ("doc_id", "th", "part")), pa.array([seen[key]], pa.int64()), pa.array([node], pa.int32()), pa.array([leaf])],
                        ["doc_id", "th", "part", "nth", "node", "text"],
                    )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, leaf_chars)
        for batch in batches:
            at = 0
            for part in _calls(batch.column("text").to_pylist()):
                own = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([enc.packed(ids) for ids, _ in enc.encoded(part)], pa.binary())], [*own.schema.names, "ids"])
                at += len(part)

    def joined(pdf) -> np.ndarray:
        enc = encoder(path, leaf_chars)
        return enc.tree(pdf["text"].tolist(), [enc.unpacked(x) for x in pdf["ids"]])

    def up(pdf):
        """Neighbours to one node."""
        own = pdf.sort_values("node")
        out = own.iloc[:1].copy()
        out["node"] //= fan
        out["text"], out["ids"] = ["".join(own["text"])], [encoder(path, leaf_chars).packed(joined(own))]
        return out

    def top(pdf):
        """The last neighbours to the whole text."""
        import pandas as pd

        own = pdf.sort_values("node")
        ids = joined(own).astype(np.int32)
        made = encoder(path, leaf_chars).results([(ids, ",".join(map(str, ids.tolist())))], keep_ids, keep_text)
        return pd.DataFrame({"doc_id": own["doc_id"].iloc[:1].tolist(), **made})

    key = ["doc_id", "th", "part", "nth"]
    node = f"doc_id {id_type}, th bigint, part int, nth bigint, node int, text string"
    long = rows.filter(size > leaf_chars).withColumn("th", F.xxhash64("text")).withColumn("part", F.spark_partition_id())
    nodes = long.mapInArrow(pieces, node).repartition(*key, "node").mapInArrow(leaves, f"{node}, ids binary")
    level = F.floor(F.col("node") / fan).alias("up")
    n = math.ceil(longest / leaf_chars) + 1  # a cut may move on
    while n > fan:
        nodes, n = nodes.groupBy(*key, level).applyInPandas(up, f"{node}, ids binary"), math.ceil(n / fan)
    return short.unionByName(nodes.groupBy(*key).applyInPandas(top, schema))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # rows are a few digests: few files of them, as a writer starts a process for each file's mode where Hadoop has no native library
    return encode_documents(docs, default_tokenizer(), keep_ids=False).hint("rebalance")
