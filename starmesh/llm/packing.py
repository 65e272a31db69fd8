"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens. For a bin, the longest length left is taken
and a subset-sum over the lengths still available, kept as a bit set, finds the fullest feasible
combination with it; the combination is then removed. Only how many pieces have each length
matters for this, and there are at most `capacity` lengths. So the combinations are found on the
histogram of lengths, of bounded size, and a combination is used as often as its lengths last.
Pieces then get their places from their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, ranked, small_batches, stored, text_chunks

CAPACITY = 2048
#: Texts of these characters are in normal form, their lower case does not depend on context, and
#: all their letters and numbers are what Python's own patterns take for such.
_PLAIN = re.compile("[\t-\r -~\u00a0-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0132-\u017e\u2010-\u2027\u20ac]*\\Z")
#: How a tokenizer must cut texts for the short way, and the same for plain texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+").findall


def short_way(kind: dict) -> bool:
    """True if a tokenizer, as its file describes it, does what TextIds does for plain texts."""
    model, steps = kind["model"], (kind.get("normalizer") or {}).get("normalizers", [])
    cuts = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [])
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    ids = [model.get("vocab", {}).get("".join(m), -1) for m in merges]
    return (
        model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        and model.get("end_of_word_suffix") == "</w>" and [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " " and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
        and cuts[0].get("pattern") == {"Regex": _PATTERN} and cuts[0].get("behavior") == "Removed" and cuts[0].get("invert") is True
        and cuts[1].get("add_prefix_space") is False and cuts[1].get("use_regex") is False
        # Merges in the order of the ids of what they make.
        and ids == sorted(ids) and -1 not in ids
    )


class TextIds:
    """Token ids of a text, as little-endian 32-bit bytes: those that `tokenizers` gives for the file.

    If the file describes the tokenizer that `short_way` looks for, plain texts are lower-cased and
    cut here, and the merges of its vocabulary are done in bulk, with a zero byte for the end of a
    word. This has the same ids at a quarter of the time. All other texts, and all texts of other
    files, go through the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = None
        if not short_way(json.loads(self.tokenizer.to_str())):
            return
        import tiktoken

        # Byte-level characters: printable Latin-1 stands for itself, the other bytes follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
        special = set(self.tokenizer.get_added_tokens_decoder())
        ranks, ids = {}, []
        for token, i in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1]):
            if i not in special:
                core = token.removesuffix("</w>")
                ranks[bytes(byte_of[c] for c in core) + b"\0" * (core != token)] = len(ids)
                ids.append(i)
        self.ids = np.array(ids, "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer

    def __call__(self, text: str) -> bytes:
        if self.merge is None or not _PLAIN.match(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = _CUT(text.lower())
        return self.ids[np.frombuffer(self.merge("\0".join(words) + "\0", set()), "<u4")].tobytes() if words else b""


_loaded: dict[str, TextIds] = {}


def text_ids(path: str) -> TextIds:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = TextIds(path)
    return _loaded[path]


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = text_ids(path)
        for batch in batches:
            for part in text_chunks(batch):
                cols: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = ids_of(text) + end if text else end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for c, v in zip(cols, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def combinations(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(combination, times)]; a combination lists (length, how many), longest first.

    counts says how many pieces have each length. Each combination holds the longest length left
    and is as full as any that does.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left, reverse=True)
    out = []
    while lengths:
        seed = lengths[0]
        room = capacity - seed
        full = 1 << room
        mask = (full << 1) - 1
        reach, trail = 1, []
        for n in lengths:
            if n > room:
                continue
            most = min(left[n] - (n == seed), room // n)
            if most <= 0:
                continue
            trail.append((n, most, reach))
            k = 1
            while most > 0:
                k = min(k, most)
                reach |= reach << (n * k) & mask
                most -= k
                k *= 2
            if reach & full:
                break
        at = reach.bit_length() - 1
        used = {seed: 1}
        for n, most, before in reversed(trail):
            k = 0
            while not before >> at & 1:
                at -= n
                k += 1
            assert k <= most
            if k:
                used[n] = used.get(n, 0) + k
        times = min(left[n] // k for n, k in used.items())
        out.append((sorted(used.items(), reverse=True), times))
        for n, k in used.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return out


def _places(combos) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length the stretches of ranks: first rank, pieces a bin, first bin, first place."""
    rows: dict[int, list] = {}
    done: dict[int, int] = {}
    first_bin = 0
    for combo, times in combos:
        place = 0
        for n, k in combo:
            rows.setdefault(n, []).append((done.get(n, 0), k, first_bin, place))
            done[n] = done.get(n, 0) + k * times
            place += n * k
        first_bin += times
    return {n: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for n, v in rows.items()}


def _place(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts):
                if len(own):
                    start, per, first_bin, place = places[int(length[own[0]])]
                    i = np.searchsorted(start, rank[own], "right") - 1
                    q, r = np.divmod(rank[own] - start[i], per[i])
                    sequence[own], offset[own] = first_bin[i] + q, place[i] + r * length[own]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and then end_id; null and empty texts are end_id alone. Only
    longer documents are cut, into pieces of `capacity` and a rest. Rows that repeat an id are
    packed each for itself; a null id stays null; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        pieces = stored(rows.mapInArrow(giving_back(_pieces(tokenizer_path, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pack-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    if not counts:
        return pieces.selectExpr("*", "0L as sequence_id", "0L as offset")
    places = _places(combinations(counts, capacity))
    order = [F.coalesce("doc_id", F.lit(-1)), F.col("piece"), F.col("ids_crc32")]
    placed = stored(ranked(pieces, ["length"], order, F.lit(1).cast("long"), "rank", sum(counts.values())), "pack-ranks")
    return placed.mapInArrow(giving_back(_place(places)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
