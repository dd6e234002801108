"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k without replacement.

A text is a lattice of pieces. Since no piece of the vocabulary runs from a non-space to a space or over a line feed,
the lattice is a chain of units (spaces and what follows them; a line feed) that only share their ends. Backward sums
over each distinct unit's lattice give the exact probability of every step.

The k samples are the leaves with the largest Gumbel-perturbed log probabilities of all segmentations, found by a
perturbed A-star search over the tree of choices: the root holds a Gumbel draw for the whole mass; along a sampled path
each unit leaves a node for all its other choices, whose perturbed value is a Gumbel for its mass truncated at the
parent's. The best open node is opened next: it draws one of its choices, draws the rest of the text, and leaves the
nodes beside the new path. Leaves come out in falling order of their perturbed value, which is the inclusion score.
All draws are hashes of (seed, row key, sample, unit, step): they depend neither on batches nor on partitions.

Piece probabilities: a vocabulary without unigram scores (BPE) ranks its pieces; a piece of rank r gets p proportional
to 1 / (r + 2). Characters without a piece are spelled in byte pieces; so is the literal U+2581, which makes decoding
exact for every text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Bytes of text taken at once: distinct units are worked out once for all of them, and a node of their lattices takes
#: some hundred bytes, so this bounds a Python worker's memory.
SLICE_BYTES = 1 << 18
#: Probabilities of steps as whole numbers.
_ONE = 1 << 40
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1), one for each 64-bit key."""
    return ((common.mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _mix_one(x: int) -> int:
    """common.mix of one number, for draws that come singly."""
    m = (1 << 64) - 1
    x &= m
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & m
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & m
    return x ^ x >> 31


def _uniform_one(x: int) -> float:
    return ((_mix_one(x) >> 11) + 0.5) / float(1 << 53)


class Vocabulary:
    """Pieces of a SentencePiece model as byte strings (a space where the model has U+2581).

    It is read once, on the driver; what goes to the tasks is a few arrays, some three megabytes.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        spelled: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        rank = np.zeros(n)
        normal: dict[bytes, int] = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            rank[i] = min(n, max(0.0, -model.get_score(i)))
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                spelled[i], self.byte_id[value], rank[i] = bytes([value]), i, n
            elif not (model.is_control(i) or model.is_unknown(i)):
                spelled[i] = piece.replace("▁", " ").encode()
                normal[spelled[i]] = i
        if any(b" " in p.lstrip(b" ") or b"\n" in p for p in normal):
            raise ValueError("a piece of this vocabulary spans units")
        logs = -np.log(rank + 2)
        self.log_p = logs - np.log(np.exp(logs).sum())
        prefixes = {p[:k]: -1 for p in normal for k in range(1, len(p) + 1)} | normal
        flat = np.frombuffer(b"".join(prefixes), np.uint8)
        ends = np.cumsum([len(p) for p in prefixes])
        hashes = common.span_sums(common.byte_sums(flat), np.concatenate([[0], ends[:-1]]), ends)
        order = np.argsort(hashes)
        self._hash, self._id = hashes[order], np.array(list(prefixes.values()), np.int32)[order]
        self._bits = 18
        self._first = np.searchsorted(self._hash >> np.uint64(64 - self._bits), np.arange((1 << self._bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.size = np.array([len(p) for p in spelled], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """For each span the id of its piece, -1 for the start of a piece, -2 for neither."""
        slot = (hashes >> np.uint64(64 - self._bits)).astype(np.int64)
        at, end = self._first[slot], self._first[slot + 1]
        out = np.full(len(hashes), -2, np.int32)
        live = np.flatnonzero(at < end)
        while len(live):
            there = at[live]
            hit = self._hash[there] == hashes[live]
            out[live[hit]] = self._id[there[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def spelled(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that pieces spell, and where each piece ends."""
        n = self.size[ids]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - n), n)
        return self.flat[at].tobytes(), ends

    def decode(self, ids: np.ndarray) -> str:
        """The text that a segmentation spells; the space before the text is dropped."""
        return self.spelled(ids)[0][1:].decode()


class _Units:
    """The distinct units of some texts with the probability of each step in their lattices."""

    def __init__(self, v: Vocabulary, texts: list[str]) -> None:
        data = np.frombuffer("".join(" " + t for t in texts if t).encode(), np.uint8)
        size = np.array([len(t.encode()) + 1 if t else 0 for t in texts], np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        before = np.concatenate([[10], data[:-1]])
        head = (data == 10) | (before == 10) | ((data == 32) & (before != 32))
        head[offsets[:-1][size > 0]] = True
        starts = np.flatnonzero(head)
        ends = np.append(starts[1:], len(data))
        self.count = np.diff(np.searchsorted(starts, offsets))
        hashes = common.hashes_of(data, starts, ends)
        _, first, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        self._lattice(v, data, starts[first], ends[first])

    def _lattice(self, v: Vocabulary, data, starts, ends) -> None:
        size = ends - starts
        base = np.concatenate([[0], np.cumsum(size)])
        n = base[-1]
        self.base = base[:-1]
        data = data[np.arange(n) + np.repeat(starts - base[:-1], size)]  # a node for each byte of the distinct units
        sums = common.byte_sums(data)
        left = np.repeat(base[1:], size) - np.arange(n)  # bytes to the unit's end
        nodes, ids = [], []
        live, k = np.arange(n), 0
        while len(live):
            k += 1
            live = live[left[live] >= k]
            got = v.find(common.span_sums(sums, live, live + k))
            hit = np.flatnonzero(got >= 0)
            nodes.append(live[hit])
            ids.append(got[hit])
            live = live[got > -2]
        lead = (data & 0xC0) != 0x80
        char = np.where(lead, np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))), 0)
        known = np.zeros(n, bool)
        for k, own in enumerate(nodes[:4]):
            known[own[char[own] == k + 1]] = True
        alone = known[np.maximum.accumulate(np.where(lead, np.arange(n), 0))] if n else known
        spelled = np.flatnonzero(~alone)
        many = np.bincount(spelled, minlength=n)
        for own in nodes:
            many[own] += 1
        edge = np.concatenate([[0], np.cumsum(many)])  # first edge of each node
        put = edge[:-1].copy()
        piece, to = np.empty(edge[-1], np.int32), np.empty(edge[-1], np.int64)
        lots = [(own, got, k + 1) for k, (own, got) in enumerate(zip(nodes, ids, strict=True))]
        for own, got, k in [*lots[::-1], (spelled, v.byte_id[data[spelled]], 1)]:  # longer pieces come first at a node
            at = put[own]
            piece[at] = got
            to[at] = np.where(left[own] == k, n, own + k)
            put[own] += 1
        beta, ways = np.full(n + 1, -np.inf), np.zeros(n + 1)
        beta[n], ways[n] = 0.0, 1.0
        share, log_q = np.empty(len(piece)), np.empty(len(piece))
        held = np.flatnonzero(many)
        near = left[held]  # nearest to the end first; a radix sort where the numbers fit into 16 bits
        held = held[np.argsort(near.astype(np.uint16) if len(near) and near.max() < 1 << 16 else near, kind="stable")]
        cuts = np.searchsorted(left[held], np.arange(1, (size.max() if len(size) else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a < b:
                at = held[a:b]
                count = many[at]
                head = np.cumsum(count) - count
                own = np.arange(head[-1] + count[-1]) + np.repeat(edge[at] - head, count)
                ahead = to[own]
                x = v.log_p[piece[own]] + beta[ahead]
                top = np.maximum.reduceat(x, head)  # finite: a character without a piece is spelled in bytes
                near = np.exp(x - np.repeat(top, count))
                mass = np.add.reduceat(near, head)
                beta[at] = top + np.log(mass)
                with np.errstate(over="ignore"):
                    ways[at] = np.add.reduceat(ways[ahead], head)
                share[own] = near / np.repeat(mass, count)
                log_q[own] = x - np.repeat(beta[at], count)
        to[to == n] = -1
        self.piece, self.to, self.edge, self.ways, self.log_q = piece, to, edge, ways[self.base], log_q
        total = np.concatenate([[0], np.cumsum((share * _ONE).astype(np.int64))])  # whole numbers: no rounding that depends on the batch
        self.upto = total[1:] - np.repeat(total[edge[:-1]], many)
        self.upto[edge[1:][many > 0] - 1] = _ONE

    def draw(self, kinds: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A path for each unit: all pieces one unit after another, pieces of each unit, log probabilities."""
        log_p, count = np.zeros(len(kinds)), np.zeros(len(kinds), np.int64)
        live, node, step, taken = np.arange(len(kinds)), self.base[kinds], 0, []
        while len(live):
            u = (common.mix(keys[live] ^ _STEP[3:] * np.uint64(step)) >> np.uint64(24)).astype(np.int64)
            edge = self.edge[node]
            more = np.flatnonzero(u >= self.upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.upto[edge[more]]]
            log_p[live] += self.log_q[edge]
            count[live] += 1
            taken.append((live, self.piece[edge]))
            node = self.to[edge]
            on = node >= 0
            live, node = live[on], node[on]
            step += 1
        at = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int64)
        for k, (who, piece) in enumerate(taken):
            out[at[who] + k] = piece
        return out, count, log_p

    def beside(self, kind: int, taken: list[tuple[int, ...]]) -> list[dict[int, tuple[int, float, list]]]:
        """For each depth the prefixes of the paths taken, by the first of these that has the prefix: the node there, what
        other paths hold of its mass, and its steps as (piece, log probability, next node, free mass, next prefix).

        The masses are sums, from the ends back, of what lies beside the paths taken, so they are right even where those
        hold nearly all of it.
        """
        levels: list[dict] = [{0: (list(range(len(taken))), int(self.base[kind]))}]
        while levels[-1]:
            deeper: dict = {}
            for members, node in levels[-1].values():
                a, b = int(self.edge[node]), int(self.edge[node + 1])
                to = dict(zip(self.piece[a:b].tolist(), self.to[a:b].tolist(), strict=True))
                for m in members:
                    piece = taken[m][len(levels) - 1]
                    if to[piece] >= 0:
                        first = next(x for x in members if taken[x][len(levels) - 1] == piece)
                        deeper.setdefault(first, ([], to[piece]))[0].append(m)
            levels.append(deeper)
        done: list[dict] = [{}]
        for depth in range(len(levels) - 2, -1, -1):
            here = {}
            for first, (members, node) in levels[depth].items():
                a, b = int(self.edge[node]), int(self.edge[node + 1])
                used = {taken[m][depth]: m for m in reversed(members)}
                steps = []
                for piece, q, to in zip(self.piece[a:b].tolist(), self.log_q[a:b].tolist(), self.to[a:b].tolist(), strict=True):
                    m = used.get(piece)
                    held = 1.0 if m is None else done[0][m][1] if m in done[0] and to >= 0 else 0.0
                    steps.append((piece, q, to, math.exp(q) * held, m))
                here[first] = (node, sum(x[3] for x in steps), steps)
            done.insert(0, here)
        return done

    def rest(self, kind: int, taken: list[tuple[int, ...]]) -> float:
        """The probability of all paths of a unit but those taken."""
        return self.beside(kind, taken)[0][0][1]

    def draw_other(self, kind: int, key: np.uint64, taken: list[tuple[int, ...]]) -> tuple[float, tuple[int, ...]]:
        """A path of a unit that is none of those taken, by its share of what they leave."""
        known, at, node = self.beside(kind, taken), 0, int(self.base[kind])
        ids, log_p, key = [], 0.0, int(key)
        while node >= 0:
            if at is not None:
                steps = known[len(ids)][at][2]
            else:
                a, b = int(self.edge[node]), int(self.edge[node + 1])
                logs = self.log_q[a:b].tolist()
                steps = [(p, q, t, math.exp(q), None) for p, q, t in zip(self.piece[a:b].tolist(), logs, self.to[a:b].tolist(), strict=True)]
            key = _mix_one(key + int(_STEP[2]))
            piece, q, node, _, at = steps[_pick([x[3] for x in steps], _uniform_one(key))]
            ids.append(piece)
            log_p += q
        return log_p, tuple(ids)


def _pick(shares: list[float], u: float) -> int:
    """The place at which a share of u of all shares is reached; never one without a share."""
    left = u * sum(shares)
    at = max(range(len(shares)), key=shares.__getitem__)
    for i, s in enumerate(shares):
        if s > 0 and left < s:
            return i
        left -= s
    return at


def _truncated(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel draw for a log mass, truncated at bound."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(u)) - mass)


def sample_texts(v: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int, seed: int) -> list[list[tuple[float, float, np.ndarray]]]:
    """For each text up to k distinct (inclusion score, log probability, piece ids), by falling score. A text with
    fewer segmentations gets all of them; an empty one has one, without pieces; a null has none."""
    units = _Units(v, [t or "" for t in texts])
    n = len(texts)
    row_key = common.mix(keys.view(np.uint64) * _STEP[0] + np.uint64(seed))
    first = np.concatenate([[0], np.cumsum(units.count)])
    row = np.repeat(np.arange(n), units.count)
    place = np.arange(first[-1]) - first[row]
    root = -np.log(-np.log(_uniform(row_key ^ _STEP[2])))
    out: list[list[tuple[float, float, np.ndarray]]] = [[(float(root[i]), 0.0, np.zeros(0, np.int64))] if texts[i] == "" else [] for i in range(n)]

    #: Of each row, its passes: (first unit drawn, bound, pieces, ends of units within them, log p upto each unit, node values, taken).
    passes: list[list[dict]] = [[] for _ in range(n)]
    nearly: dict = {}
    todo = [(i, None, root[i]) for i in range(n) if units.count[i]]
    for turn in range(k):
        if not todo:
            break
        begin = np.array([0 if opened is None else opened[1] + 1 for _, opened, _ in todo], np.int64)
        who = np.array([i for i, _, _ in todo], np.int64)
        many = units.count[who] - begin
        at = np.repeat(first[who] + begin, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        key = common.mix(row_key[row[at]] + place[at].astype(np.uint64) * _STEP[1] + np.uint64(turn) * _STEP[2])
        ids, count, log_p = units.draw(units.kind[at], key)
        piece_cut, unit_cut = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(many)])
        kinds, last = units.kind[at], turn + 1 == k  # the last sample leaves no nodes
        beside = np.full(len(kinds), -np.inf)
        if not last:
            several = np.flatnonzero(units.ways[kinds] > 1)
            with np.errstate(divide="ignore"):
                beside[several] = np.log(np.maximum(-np.expm1(log_p[several]), 0))
            for j in several[log_p[several] > -1e-12].tolist():  # too near to 1 to subtract
                path = tuple(ids[piece_cut[j] : piece_cut[j + 1]].tolist())
                if (kinds[j], path) not in nearly:
                    nearly[kinds[j], path] = math.log(units.rest(int(kinds[j]), [path]) or 5e-324)
                beside[j] = nearly[kinds[j], path]
            spread = _uniform(key ^ _STEP[0])
        for j, (i, opened, bound) in enumerate(todo):
            a, b = unit_cut[j], unit_cut[j + 1]
            own, lead_log, lead_ids = ids[piece_cut[a] : piece_cut[b]], 0.0, np.zeros(0, np.int64)
            if opened is not None:  # the node's own choice, and the path before it
                p, t = opened
                parent = passes[i][p]
                u = t - parent["begin"]
                taken = parent["taken"].setdefault(t, [tuple(parent["ids"][parent["cut"][u] : parent["cut"][u + 1]].tolist())])
                other_key = common.mix(np.array([row_key[i] + np.uint64(turn)]) ^ _STEP[1])[0]
                kind = int(units.kind[first[i] + t])
                lp, path = units.draw_other(kind, other_key, taken)
                taken.append(path)
                before = parent["log"][u]
                lead_log, lead_ids = before + lp, np.concatenate([parent["head"], parent["ids"][: parent["cut"][u]], np.array(path, np.int64)])
                if not last:
                    left = math.log(units.rest(kind, taken) or 5e-324) if len(taken) < units.ways[kind] else -math.inf
                    parent["node"][u] = _truncated(before + left, bound, _uniform(np.array([other_key ^ _STEP[3]])))[0] if math.isfinite(left) else -np.inf
            log = lead_log + np.concatenate([[0.0], np.cumsum(log_p[a:b])])
            node = np.full(b - a, -np.inf)
            near = np.flatnonzero(np.isfinite(beside[a:b]))
            if len(near):
                node[near] = _truncated(log[near] + beside[a:b][near], bound, spread[a:b][near])
            passes[i].append({"begin": int(begin[j]), "ids": own, "cut": piece_cut[a : b + 1] - piece_cut[a], "log": log, "node": node, "head": lead_ids, "taken": {}})
            out[i].append((float(bound), float(log[-1]), np.concatenate([lead_ids, own])))
        todo = []
        for i in range(n) if turn + 1 < k else ():
            best = max(((float(x["node"].max(initial=-np.inf)), p) for p, x in enumerate(passes[i])), default=(-np.inf, 0))
            if np.isfinite(best[0]):
                x = passes[i][best[1]]
                todo.append((i, (best[1], x["begin"] + int(x["node"].argmax())), best[0]))
    return out


def _rows(shared, key: str, k: int, seed: int, digest: bool, keep: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for whole in batches:
            for batch in common.text_slices(whole, limit=SLICE_BYTES):
                texts, keys = batch.column("text").to_pylist(), batch.column(key)
                drawn = sample_texts(v, texts, keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), k, seed)
                many = np.array([len(d) for d in drawn])
                every = [s for d in drawn for s in d]
                columns = [
                    keys.take(pa.array(np.repeat(np.arange(len(many)), many))),
                    pa.array([r + 1 for m in many.tolist() for r in range(m)], pa.int32()),
                    pa.array([s[0] for s in every], pa.float64()), pa.array([s[1] for s in every], pa.float64()),
                    pa.array([len(s[2]) for s in every], pa.int64()),
                ]
                names = [key, "rank", "score", "log_prob", "n_pieces"]
                if digest:
                    many_ids = np.concatenate([s[2] for s in every]) if every else np.zeros(0, np.int64)
                    spelled, ends = v.spelled(many_ids)  # all samples at once
                    cut = np.concatenate([[0], ends])[np.cumsum([0, *(len(s[2]) for s in every)])].tolist()
                    whole_texts = [t.encode() if t else b"" for t, d in zip(texts, drawn, strict=True) for _ in d]
                    same = [spelled[a + 1 : b] == t for a, b, t in zip(cut[:-1], cut[1:], whole_texts, strict=True)]
                    columns += [pa.array([hashlib.md5(s[2].astype("<i4").tobytes()).hexdigest() for s in every], pa.string()), pa.array(same, pa.bool_())]
                    names += ["ids_md5", "round_trip"]
                else:
                    ids = np.concatenate([s[2] for s in every]) if every else np.zeros(0)
                    ends = np.concatenate([[0], np.cumsum([len(s[2]) for s in every])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                if keep:
                    columns.append(batch.column(keep).take(pa.array(np.repeat(np.arange(len(many)), many))))
                    names.append(keep)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_samples(docs: DataFrame, model_path: str, key: str = "doc_id", k: int = 2, seed: int = 1, digest: bool = False, keep: str | None = None) -> DataFrame:
    """(key, rank, score, log_prob, n_pieces, ids) for up to k distinct sampled segmentations of every text.

    docs needs the integer key and text; the model file is read on the driver and sent to all. With digest, ids are
    replaced by ids_md5, over their little-endian 32-bit form, and round_trip: whether decoding gives the text back.
    Rows with the same key and text get the same samples; a null key draws as 0. A null text gives no row.
    keep names a text column of docs that every sample carries on.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model_path))
    last = "ids_md5 string, round_trip boolean" if digest else "ids array<int>"
    kept, columns = (f", {keep} string", [key, "text", keep]) if keep else ("", [key, "text"])
    return docs.select(*columns).mapInArrow(
        common.releasing(_rows(shared, key, k, seed, digest, keep)), f"{common.quoted(key)} long, rank int, score double, log_prob double, n_pieces long, {last}{kept}"
    )


def _decoded(shared, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            texts = [v.decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)) if x.is_valid else None for x in batch.column("ids")]  # one row as numbers at a time
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*schema_names, "text"])

    return run


def decode_samples(samples: DataFrame, model_path: str) -> DataFrame:
    """samples, which needs ids, plus the text that they spell; null ids give a null text. A column text is replaced."""
    shared = samples.sparkSession.sparkContext.broadcast(Vocabulary(model_path))
    samples = samples.drop("text")
    plain = common.numbered(samples, "ids")
    schema = T.StructType(list(plain.schema.fields)).add("text", "string")
    return plain.mapInArrow(common.releasing(_decoded(shared, plain.columns)), schema).toDF(*samples.columns, "text")
