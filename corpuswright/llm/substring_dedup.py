"""Removal of repeated byte strings with a sparse suffix array.

A byte goes if a `width`-byte string over it also starts in a document with a smaller doc_id. Windows of `width` bytes are the
suffixes that matter; they are compared by sorting, but only those that can repeat.

1. Groups. Documents are dealt by hash into groups of about GROUP_BYTES of text, once; all three steps below that need texts
   read that one exchange again. What a group sends is pre-aggregated over all its documents, and what comes back names
   content, not places, so a lost task that runs again finds the same.
2. Anchors. Each window has an anchor: the gram of GRAM bytes in it with the least hash (the leftmost on a tie). Equal windows
   have equal anchors at the same place, so a window whose anchor occurs in no other document repeats in none. A group sends
   the hashes of its anchors, each once, to ranges of the hash; those that another group has come back.
3. Pieces. Consecutive windows with one repeated anchor make a piece, sent as a record of fixed length: the bytes around the
   anchor, those outside the piece's windows zero. A group sends equal pieces once, with the least doc_id that holds them.
4. Suffix buckets. Sampled splitters range-partition the pieces by their anchor's bytes, the leading tokens of all their
   windows. A bucket sorts its windows' suffixes by multikey quicksort, eight bytes at a time; equal ones share the least
   doc_id. A splitter never parts equal leads, so there is nothing to compare across boundaries. A lead of over HOT_DOCS
   documents (the edge of a passage that very many share) is not one bucket's: its windows are dealt by all their bytes.
5. A bucket tells a group which windows of its pieces a smaller document outside has; what its own documents repeat of each
   other the group sees itself.

Copies of a whole text are found first, by digest, and are removed as wholes. Keys of 64 bits stand for the pieces of one
group (some ten thousand, so that two different ones meet in a group with odds of 1e-11).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, GOLDEN, cut, mix64, powers, text_rows, utf8_buffers, with_ids, without_ids

WIDTH = 50
GRAM = 16
CHUNK = 1 << 18
GROUP_BYTES = 1 << 22
HOT_DOCS = 20_000
SPLITTER_DOCS = 1000  # for the splitters at least so many documents are read, and one a bucket: they only balance the buckets
_POSITION_BITS = np.uint64(24)
_LOW_BITS = np.uint64(16)
_LETTER = "g int, copy_id long, copy_h long, keys binary, masks binary, grams binary, hot binary"


def window_anchors(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, the position of its anchor; and the hash of the gram at each position. len(data) < 2**24."""
    n = len(data) - gram + 1
    if len(data) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    hashes = mix64((sums[gram:] - sums[:n]) * down[:n])
    least = (hashes >> _POSITION_BITS) << _POSITION_BITS | np.arange(n, dtype=np.uint64)
    span, have = width - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if span > have:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64), hashes


def chunks(starts: np.ndarray, width: int, chunk: int):
    """(first byte, last byte, first text, last text + 1) of pieces of about `chunk` bytes: whole texts, or parts of a long one
    that overlap by width - 1, so that each window is in exactly one piece."""
    i, n = 0, len(starts) - 1
    while i < n:
        if starts[i + 1] - starts[i] > chunk:
            at = starts[i]
            while True:
                end = min(at + chunk, starts[i + 1])
                yield at, end, i, i + 1
                if end == starts[i + 1]:
                    break
                at = end - (width - 1)
            i += 1
        else:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + chunk, side="right")) - 1)
            yield starts[i], starts[j], i, j
            i = j


def anchored_runs(data: np.ndarray, starts: np.ndarray, width: int, gram: int, chunk: int = CHUNK) -> list[np.ndarray]:
    """Text, first window, last window, anchor and 48-bit hash of each run of consecutive windows with one anchor."""
    parts = [[np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]]
    for lo, hi, i, j in chunks(starts, width, chunk):
        anchor, hashes = window_anchors(data[lo:hi], width, gram)
        n = len(anchor)
        first = np.clip(starts[i:j] - lo, 0, n)
        stop = np.clip(np.minimum(starts[i + 1 : j + 1], hi) - lo - width + 1, first, n)
        edge = np.zeros(n + 1, dtype=np.int32)  # windows that do not cross into the next text
        np.add.at(edge, first, 1)
        np.add.at(edge, stop, -1)
        on = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if not len(on):
            continue
        begin = np.flatnonzero(np.r_[True, (on[1:] != on[:-1] + 1) | (anchor[on[1:]] != anchor[on[:-1]])])
        s, e = on[begin], on[np.r_[begin[1:] - 1, len(on) - 1]]
        text = i + np.searchsorted(starts[i:j] - lo, s, side="right") - 1
        parts.append([text, s + lo, e + lo, anchor[s] + lo, hashes[anchor[s]] >> _LOW_BITS])
    return [np.concatenate(x) for x in zip(*parts)]


def piece_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, a: np.ndarray, width: int, gram: int) -> np.ndarray:
    """A row of 8-byte words a piece: 2 * width - gram bytes around the anchor, zero outside the windows s to e, and how far
    before the anchor the first and the last window start."""
    reach = width - gram
    used = 2 * width - gram
    size = -(-(used + 2) // 8) * 8
    padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(size, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, size)
    out = np.empty((len(s), size), dtype=np.uint8)
    place = np.arange(size)
    for lo in range(0, len(s), 8192):
        p = slice(lo, lo + 8192)
        begin, end = (reach - (a[p] - s[p]))[:, None], (reach - (a[p] - e[p]) + width)[:, None]
        out[p] = np.where((place >= begin) & (place < end), view[a[p]], 0)
    out[:, used], out[:, used + 1] = a - s, a - e
    return out.view(np.uint64)


def _keys(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), dtype=np.uint64)
    for d in range(words.shape[1]):
        out = mix64(out ^ words[:, d]) + GOLDEN
    return out


def _gram_hashes(raw: np.ndarray, width: int, gram: int) -> np.ndarray:
    """The 48-bit hash of each record's anchor."""
    up, _ = powers(gram)
    return mix64((BYTE_VALUES[raw[:, width - gram : width]] * up).sum(axis=1, dtype=np.uint64)) >> _LOW_BITS


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of a matrix of big-endian words, and for each sorted row whether it differs from the one before.

    Multikey quicksort: rows are sorted by one word at a time, and only runs that agree so far go on to the next word.
    """
    n, depth = words.shape
    order = np.argsort(words[:, 0], kind="stable")
    first = words[order, 0]
    new = np.r_[True, first[1:] != first[:-1]] if n else np.zeros(0, bool)
    for d in range(1, depth):
        run = np.cumsum(new) - 1
        open_rows = np.flatnonzero(np.bincount(run, minlength=1)[run] > 1)
        if not len(open_rows):
            break
        own = run[open_rows]
        key = words[order[open_rows], d]
        again = np.lexsort((key, own))
        order[open_rows] = order[open_rows[again]]
        key = key[again]
        new[open_rows] |= np.r_[True, (key[1:] != key[:-1]) | (own[1:] != own[:-1])]
    return order, new


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blobs: list[bytes]) -> np.ndarray:
    low = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, :6] = low
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _values(table: pa.Table, name: str) -> list:
    """A column's values; the side of a cogroup that has no rows has no columns either."""
    return table[name].to_pylist() if table.num_rows else []


def _blobs(table: pa.Table, name: str) -> list[bytes]:
    return [b for b in _values(table, name) if b is not None]


def _numbers(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(_blobs(table, name)), dtype=dtype)


def _texts(table: pa.Table, letters: pa.Table):
    """doc_ids, bytes and starts of a group's texts, h, and which of the rows are copies of another document's text."""
    text = table["text"].cast(pa.large_string()).combine_chunks()
    data, starts = utf8_buffers(text) if isinstance(text, pa.Array) else utf8_buffers(pa.concat_arrays(text.chunks))
    ids, h = (table[c].to_numpy() for c in ("doc_id", "h"))
    told = {p for p in zip(_values(letters, "copy_id"), _values(letters, "copy_h")) if p[1] is not None}
    copy = np.fromiter(((i, x) in told for i, x in zip(ids.tolist(), h.tolist())), dtype=bool, count=len(ids)) if told else np.zeros(len(ids), bool)
    return ids, data, starts, copy


def _runs_of(table: pa.Table, letters: pa.Table, width: int, gram: int, chunk: int):
    ids, data, starts, copy = _texts(table, letters)
    text, s, e, a, h = anchored_runs(data, starts, width, gram, chunk)
    if copy.any():
        text, s, e, a, h = (x[~copy[text]] for x in (text, s, e, a, h))
    return ids, data, starts, copy, text, s, e, a, h


def _shared_here(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes, and in how many of the group's texts each occurs."""
    order = np.lexsort((text, h))
    h, text = h[order], text[order]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    apart = new | np.r_[True, text[1:] != text[:-1]] if len(h) else new
    begin = np.flatnonzero(new)
    return h[begin], np.add.reduceat(apart.astype(np.int64), begin) if len(begin) else np.zeros(0, np.int64)


def _ask(buckets: int, width: int, gram: int, chunk: int):
    """Each anchor hash of a group once: those of one text, and those of several with how many."""

    def run(key, table: pa.Table, letters: pa.Table) -> pa.Table:
        _, _, _, _, text, _, _, _, h = _runs_of(table, letters, width, gram, chunk)
        h, n = _shared_here(text, h)
        bucket = (h * np.uint64(buckets)) >> np.uint64(48)
        edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            p = slice(edges[k], edges[k + 1])
            one = n[p] == 1
            rows.append((k, _six(h[p][one]), _six(h[p][~one]), np.minimum(n[p][~one], 2**31).astype(np.uint32).tobytes()))
        return _table(rows, "bucket int, g int, one binary, several binary, counts binary", g=key[0].as_py())

    return run


def _arrow_type(name: str):
    return {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[name]


def _table(rows: list[tuple], schema: str, **fixed) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = iter(zip(*rows)) if rows else iter([()] * len(fields))
    arrays = [pa.array([fixed[n]] * len(rows) if n in fixed else next(columns), type=_arrow_type(t)) for n, t in fields]
    return pa.table(arrays, names=[n for n, _ in fields])


def _answer(most: int):
    """To each group, those of its anchors that another group has too, and those that very many documents have."""

    def run(table: pa.Table) -> pa.Table:
        one, several = table["one"].to_pylist(), table["several"].to_pylist()
        h = np.concatenate([_from_six(one), _from_six(several)])
        who = np.arange(len(one), dtype=np.int32)
        of = np.concatenate([np.repeat(who, [len(b) // 6 for b in x]) for x in (one, several)])
        single = sum(map(len, one)) // 6
        n = np.ones(len(h), dtype=np.uint32)
        n[single:] = _numbers(table, "counts", np.uint32)
        order = np.argsort(h, kind="stable")
        begin = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        total = np.empty(len(h), dtype=np.int64)
        total[order] = np.repeat(np.add.reduceat(n[order], begin, dtype=np.int64), np.diff(np.r_[begin, len(h)]))
        found, hot = np.flatnonzero((total > 1) & (n == 1)), np.flatnonzero(total > most)
        pick = lambda at: (lambda o: (h[o], np.searchsorted(of[o], np.arange(len(one) + 1))))(at[np.argsort(of[at], kind="stable")])
        (fh, fe), (hh, he) = pick(found), pick(hot)
        g = table["g"].to_pylist()
        rows = [
            (g[k], None, None, None, None, _six(fh[fe[k] : fe[k + 1]]), _six(hh[he[k] : he[k + 1]]))
            for k in range(len(g)) if fe[k + 1] > fe[k] or he[k + 1] > he[k]
        ]
        return _table(rows, _LETTER)

    return run


def _pieces(data, starts, text, s, e, a, h, wanted: np.ndarray, hot: np.ndarray, width: int, gram: int):
    """Text, first and last window, anchor, words and key of the pieces with a wanted anchor; hot ones window by window."""
    use = np.isin(h, wanted)
    text, s, e, a, h = (x[use] for x in (text, s, e, a, h))
    many = np.isin(h, hot) if len(hot) else np.zeros(len(h), bool)
    if many.any():
        n = np.where(many, e - s + 1, 1)
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        text, a, whole, last = (np.repeat(x, n) for x in (text, a, ~many, e))
        s = np.repeat(s, n) + step
        e = np.where(whole, last, s)
        many = ~whole
    words = piece_words(data, s, e, a, width, gram)
    return text, s, e, a, many, words, _keys(words)


def _send(splitters: np.ndarray, buckets: int, width: int, gram: int, chunk: int):
    def run(key, table: pa.Table, letters: pa.Table) -> pa.Table:
        ids, data, starts, _, text, s, e, a, h = _runs_of(table, letters, width, gram, chunk)
        known, n = _shared_here(text, h)
        wanted = np.concatenate([known[n > 1], _from_six(_blobs(letters, "grams"))])
        hot = _from_six(_blobs(letters, "hot"))
        text, s, e, a, many, words, keys = _pieces(data, starts, text, s, e, a, h, np.concatenate([wanted, hot]), hot, width, gram)
        order = np.lexsort((ids[text], keys))  # equal pieces once, for the least doc_id
        order = order[np.r_[True, keys[order][1:] != keys[order][:-1]]] if len(order) else order
        raw = words.view(np.uint8).reshape(len(words), 8 * words.shape[1])[order]
        owner, many = ids[text][order].astype(np.int64), many[order]
        lead = np.ascontiguousarray(raw[:, width - gram : width]).view(f"S{gram}").reshape(-1)
        bucket = np.where(many, (keys[order] % np.uint64(buckets)).astype(np.int64), np.searchsorted(splitters, lead, side="right"))
        by = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
        rows = []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            p = by[edges[k] : edges[k + 1]]
            rows.append((k, raw[p].tobytes(), owner[p].tobytes(), many[p].tobytes()))
        return _table(rows, "bucket int, g int, pieces binary, owners binary, many binary", g=key[0].as_py())

    return run


def _resolve(width: int, gram: int):
    """To each group, which windows of its pieces a document outside with a smaller doc_id has, and its hot anchors."""
    used = 2 * width - gram
    size = -(-(used + 2) // 8) * 8
    reach = width - gram

    def masks_of(raw: np.ndarray, owners: np.ndarray) -> np.ndarray:
        before, last = raw[:, used].astype(np.int64), raw[:, used + 1].astype(np.int64)
        counts = before - last + 1
        of = np.repeat(np.arange(len(raw)), counts)
        at = reach - np.repeat(before, counts) + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        windows = np.zeros((len(of), -(-width // 8) * 8), dtype=np.uint8)
        windows[:, :width] = np.lib.stride_tricks.sliding_window_view(raw, width, axis=1)[of, at]
        order, new = multikey_order(windows.view(">u8").astype(np.uint64))
        begin = np.flatnonzero(new)
        least = np.empty(len(of), dtype=np.int64)
        least[order] = np.repeat(np.minimum.reduceat(owners[of[order]], begin), np.diff(np.r_[begin, len(of)]))
        bits = np.where(least < owners[of], np.uint64(1) << at.astype(np.uint64), np.uint64(0))
        return np.bitwise_or.reduceat(bits, np.cumsum(counts) - counts)

    def run(table: pa.Table) -> pa.Table:
        blobs = table["pieces"].to_pylist()
        raw = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, size)
        owners, many = _numbers(table, "owners", np.int64), _numbers(table, "many", np.bool_)
        lead = np.ascontiguousarray(raw[:, reach:width]).view(f"S{gram}").reshape(-1)
        order = np.argsort(lead, kind="stable")
        begin = np.flatnonzero(np.r_[True, lead[order][1:] != lead[order][:-1]])
        masks = np.empty(len(raw), dtype=np.uint64)
        lo = 0
        while lo < len(order):  # whole leads, about 4,000 pieces at a time
            nxt = np.searchsorted(begin, lo + 4000)
            hi = len(order) if nxt >= len(begin) else max(int(begin[nxt]), lo + 1)
            p = order[lo:hi]
            masks[p] = masks_of(raw[p], owners[p])
            lo = hi
        edges = np.r_[0, np.cumsum([len(b) // size for b in blobs])]
        rows = []
        for k, g in enumerate(table["g"].to_pylist()):
            mine = raw[edges[k] : edges[k + 1]]
            tell, hot = masks[edges[k] : edges[k + 1]] > 0, many[edges[k] : edges[k + 1]]
            if not (tell | hot).any():
                continue
            keys = _keys(np.ascontiguousarray(mine[tell]).view(np.uint64))
            grams, hots = (np.unique(_gram_hashes(mine[x], width, gram)) for x in (tell & ~hot, hot))
            rows.append((g, None, None, keys.tobytes(), masks[edges[k] : edges[k + 1]][tell].tobytes(), _six(grams), _six(hots)))
        return _table(rows, _LETTER)

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _erase(width: int, gram: int, chunk: int):
    reach = width - gram

    def run(key, table: pa.Table, letters: pa.Table) -> pa.Table:
        ids, data, starts, copy, text, s, e, a, h = _runs_of(table, letters, width, gram, chunk)
        known, n = _shared_here(text, h)
        grams, hot = _from_six(_blobs(letters, "grams")), _from_six(_blobs(letters, "hot"))
        text, s, e, a, _, _, keys = _pieces(data, starts, text, s, e, a, h, np.concatenate([known[n > 1], grams, hot]), hot, width, gram)
        told, masks = _numbers(letters, "keys", np.uint64), _numbers(letters, "masks", np.uint64)
        by = np.argsort(told, kind="stable")
        told, masks = told[by], masks[by]
        owner = ids[text].astype(np.int64)
        order = np.argsort(keys, kind="stable")
        begin = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]]) if len(order) else np.zeros(0, np.int64)
        least = np.empty(len(keys), dtype=np.int64)
        if len(order):
            least[order] = np.repeat(np.minimum.reduceat(owner[order], begin), np.diff(np.r_[begin, len(order)]))
        mask = np.zeros(len(keys), dtype=np.uint64)
        if len(told):
            at = np.minimum(np.searchsorted(told, keys), len(told) - 1)
            mask = np.where(told[at] == keys, masks[at], np.uint64(0))
        mask[owner > least] = np.uint64(2**64 - 1)  # another document of this group has the whole piece
        on = np.flatnonzero(mask)
        counts = e[on] - s[on] + 1
        of = np.repeat(on, counts)
        start = s[of] + np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = start[(mask[of] >> (reach - (a[of] - start)).astype(np.uint64)) & np.uint64(1) > 0]
        edge = np.zeros(len(data) + 1, dtype=np.int16)  # at most `width` windows start in reach of a byte
        np.add.at(edge, start, 1)
        np.add.at(edge, start + width, -1)
        gone = np.empty(len(data), dtype=bool)
        level = 0
        for lo in range(0, len(data), chunk):
            depth = level + np.cumsum(edge[lo : min(lo + chunk, len(data))], dtype=np.int64)
            gone[lo : lo + chunk] = depth > 0
            level = int(depth[-1])
        rows = []
        for k, doc_id in enumerate(ids.tolist()):
            lost, mine = gone[starts[k] : starts[k + 1]], data[starts[k] : starts[k + 1]]
            kept = b"" if copy[k] else mine[~lost].tobytes()
            spans = int(copy[k]) if copy[k] or not len(lost) else int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
            rows.append((doc_id, len(mine), len(mine) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return _table(rows, _RESULT)

    return run


def _splitters(rows: DataFrame, n_rows: int, buckets: int, width: int, gram: int) -> np.ndarray:
    """At most buckets - 1 anchors' bytes that part those of a sample of documents into equal shares."""

    def run(batches):
        for b in batches:
            data, starts = utf8_buffers(b["text"])
            _, _, _, a, h = anchored_runs(data, starts, width, gram)
            a = a[h % np.uint64(16) == 0]
            yield pa.record_batch([pa.array([data[x : x + gram].tobytes() for x in a.tolist()], type=pa.binary())], names=["lead"])

    every = max(1, n_rows // max(SPLITTER_DOCS, buckets))
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text")
    leads = sorted(r["lead"] for r in sample.mapInArrow(run, "lead binary").collect())
    picks = [leads[len(leads) * k // buckets] for k in range(1, buckets)] if leads else []
    return np.array(sorted(set(picks)), dtype=f"S{gram}")


def remove_repeats(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_docs: int = HOT_DOCS, group_bytes: int = GROUP_BYTES, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every row of `docs`.

    Strings are judged on the input, overlaps count, and repeats inside one document or between rows with one doc_id stay.
    A repeated doc_id gives a row each time, each judged by its own text. Null texts are empty; texts under `width` bytes are
    never touched; an empty table gives an empty result. Each row without doc_id is a document of its own, after all that have
    one. `gram` is less than `width`, and `width` at most 63 more. The last three parameters deal
    the work and change no result.
    """
    known, top = with_ids(docs)
    return without_ids(_remove_repeats(known, width, gram, hot_docs, group_bytes, chunk), top)


def _remove_repeats(docs: DataFrame, width: int, gram: int, hot_docs: int, group_bytes: int, chunk: int) -> DataFrame:
    """remove_repeats of rows which all have a doc_id."""
    spark = docs.sparkSession
    rows = text_rows(docs).withColumn("h", F.xxhash64("text"))
    digests = cut(rows.select("doc_id", "h", F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("digest")))
    size = digests.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, int(size["bytes"]) // group_bytes, size["n"] >> 16)
    group = F.pmod(F.xxhash64("doc_id", "h"), F.lit(groups)).cast("int").alias("g")
    several = digests.where(F.col("n_bytes") >= width).groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top")).where("owner < top")
    copies = cut(digests.join(several.select("digest", "owner"), "digest").where("doc_id > owner").select("doc_id", "h", group).distinct())
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("keys", "masks", "grams", "hot")]
    letters = copies.select(F.col("g").alias("g"), F.col("doc_id").alias("copy_id"), F.col("h").alias("copy_h"), *nothing)

    texts = rows.select("doc_id", "h", "text", group).groupBy("g")
    ask_buckets = max(least, int(size["bytes"]) >> 24)
    buckets = max(least, int(size["bytes"]) >> 23)
    splitters = _splitters(rows, size["n"], buckets, width, gram)
    asked = texts.cogroup(letters.groupBy("g")).applyInArrow(_ask(ask_buckets, width, gram, chunk), "bucket int, g int, one binary, several binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answer(hot_docs), _LETTER).unionByName(letters)
    sent = texts.cogroup(answers.groupBy("g")).applyInArrow(_send(splitters, buckets, width, gram, chunk), "bucket int, g int, pieces binary, owners binary, many binary")
    resolved = sent.groupBy("bucket").applyInArrow(_resolve(width, gram), _LETTER).unionByName(letters)
    return texts.cogroup(resolved.groupBy("g")).applyInArrow(_erase(width, gram, chunk), _RESULT)
