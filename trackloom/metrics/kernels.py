"""Per-sequence accuracy kernels over (frame, gid, tid, sim) rows; gid or tid is null on a row of one side only."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd

from .assignment import assign

EPS = np.finfo(float).eps
ALPHAS = np.arange(1, 20) * 0.05


def _distinct(frame: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of frame and id, in their order."""
    order = np.lexsort((own, frame))
    frame, own = frame[order], own[order]
    new = np.ones(len(own), bool)
    new[1:] = (frame[1:] != frame[:-1]) | (own[1:] != own[:-1])
    return frame[new], own[new]


class Sequence:
    """Frames of a sequence: ids of both sides and the similarities of those that overlap, as columns; a frame is put together when its turn comes, and never as a matrix of all its ids."""

    def __init__(self, pdf: pd.DataFrame):
        has = [pdf[c].notna().to_numpy() for c in ("gid", "tid")]
        ids = [pdf[c].to_numpy()[h].astype(np.int64) for c, h in zip(("gid", "tid"), has, strict=True)]
        self._fill(pdf["frame"].to_numpy(np.int64), has, ids, pdf["sim"].to_numpy(float))

    @classmethod
    def of(cls, pieces: list[tuple]) -> Sequence:
        """From pieces of columns: frame, gid known, tid known, gid and tid where they are, sim."""
        self = cls.__new__(cls)
        frame, has_g, has_t, g, t, sim = (np.concatenate(c) for c in zip(*pieces, strict=True))
        self._fill(frame, [has_g, has_t], [g, t], sim)
        return self

    def _fill(self, frame: np.ndarray, has: list[np.ndarray], ids: list[np.ndarray], sim: np.ndarray) -> None:
        self.own = [_distinct(frame[h], i) for h, i in zip(has, ids, strict=True)]
        self.gt, self.tr = (dict(zip(*(x.tolist() for x in np.unique(i, return_counts=True)), strict=True)) for _, i in self.own)
        both = has[0] & has[1]
        f, g, t, s = frame[both], ids[0][both[has[0]]], ids[1][both[has[1]]], sim[both]
        order = np.lexsort((t, g, f))
        f, g, t, s = (x[order] for x in (f, g, t, s))
        last = np.ones(len(f), bool)
        last[:-1] = (f[1:] != f[:-1]) | (g[1:] != g[:-1]) | (t[1:] != t[:-1])
        last &= s != 0
        self.f, self.g, self.t, self.s = (x[last] for x in (f, g, t, s))
        self.at = np.unique(np.concatenate([self.own[0][0], self.own[1][0]]))

    def frames(self, value: np.ndarray | None = None):
        """frame, ids of both sides, and (gid, tid) to similarity, or ``value``, of those that overlap."""
        value = self.s if value is None else value
        cuts = [np.searchsorted(x, self.at, side).tolist() for x in (self.own[0][0], self.own[1][0], self.f) for side in ("left", "right")]
        for f, a, b, c, d, i, j in zip(self.at.tolist(), *cuts, strict=True):
            yield f, self.own[0][1][a:b].tolist(), self.own[1][1][c:d].tolist(), dict(zip(zip(self.g[i:j].tolist(), self.t[i:j].tolist(), strict=True), value[i:j].tolist(), strict=True))


class Passing:
    """A sequence of which one frame is held at a time, for kernels that take its frames once and in their order; ``gt`` and ``at`` hold what has passed."""

    def __init__(self, frames: Iterable[list[tuple]]):
        self.left, self.gt, self.at = frames, Counter(), []

    def frames(self):
        for pieces in self.left:
            one = Sequence.of(pieces)
            self.gt.update(one.gt)
            self.at += one.at.tolist()
            yield from one.frames()


def _kept(seq: Sequence | Passing, least: float):
    """Ids of both sides of each frame, and the partners, with the sum of their similarity, that partners of the last frame with both sides go before; None if a side is empty."""
    now: dict[int, int] = {}
    for _, g, t, near in seq.frames():
        if not g or not t:
            yield g, t, None, 0.0
            continue
        match, total = {}, 0.0
        for a, b, sim in _meetings(near):
            if sim.size == 1:  # nothing to choose
                if sim[0, 0] >= least - EPS:
                    match[a[0]] = b[0]
                    total += float(sim[0, 0])
                continue
            bonus = np.array([[now.get(x) == y for y in b] for x in a])
            score = np.where(sim < least - EPS, 0.0, sim + 1000.0 * bonus)
            for r, c in zip(*assign(-score), strict=True):
                if score[r, c] > 0:
                    match[a[r]] = b[c]
                    total += float(sim[r, c])
        now = match
        yield g, t, match, total


def clear(seq: Sequence | Passing, least: float = 0.5) -> dict:
    """TP, FN, FP, identity switches, fragments, MT/PT/ML and the summed similarity of matches."""
    out = Counter()
    held: dict[int, int] = {}  # last partner of a ground truth id
    now: dict[int, int] = {}  # partners in the last frame that had both sides
    tracked, runs = Counter(), Counter()
    total = 0.0
    for g, t, match, sim in _kept(seq, least):
        if match is None:
            out["fn"] += len(g)
            out["fp"] += len(t)
            continue
        out["idsw"] += sum(held.get(a, b) != b for a, b in match.items())
        for a in match:
            tracked[a] += 1
            runs[a] += a not in now
        held |= match
        now = match
        total += sim
        out["tp"] += len(match)
        out["fn"] += len(g) - len(match)
        out["fp"] += len(t) - len(match)
    share = {a: tracked[a] / n for a, n in seq.gt.items()}
    mt = sum(s > 0.8 for s in share.values())
    pt = sum(s >= 0.2 for s in share.values()) - mt
    return {"tp": out["tp"], "fn": out["fn"], "fp": out["fp"], "idsw": out["idsw"], "frag": sum(n - 1 for n in runs.values() if n), "mt": mt, "pt": pt, "ml": len(share) - mt - pt, "sim_sum": total, "frames": len(seq.at)}


def _together(seq: Sequence, least: float) -> Counter:
    """In how many frames a pair of ids overlaps by ``least`` or more."""
    ok = seq.s >= least
    return Counter(zip(seq.g[ok].tolist(), seq.t[ok].tolist(), strict=True))


def identity(seq: Sequence, least: float = 0.5) -> dict:
    """IDTP, IDFN, IDFP of the one-to-one identity mapping of least cost."""
    both = _together(seq, least)
    # The errors are all boxes less two for each true positive: the most true positives are wanted. Ids that never meet don't matter to
    # each other, so each connected part is solved alone.
    tp = sum(common[r, c].sum() for _, _, common in _meetings(both) for r, c in [assign(-common)])
    return {"idtp": int(tp), "idfn": sum(seq.gt.values()) - int(tp), "idfp": sum(seq.tr.values()) - int(tp)}


def assigned_shares(pdf: pd.DataFrame) -> pd.DataFrame:
    """seq, gid, j of the one-to-one assignment of the largest sum, from the rows (seq, gid, tid, j) of a sequence."""
    both = {(g, t): j for g, t, j in zip(pdf["gid"].tolist(), pdf["tid"].tolist(), pdf["j"].tolist(), strict=True)}
    rows = [(gt[i], share[i, k]) for gt, _, share in _meetings(both) for i, k in zip(*assign(-share), strict=True) if share[i, k] > 0]
    return pd.DataFrame({"seq": pdf["seq"].iloc[0], "gid": [g for g, _ in rows], "j": [j for _, j in rows]})


def assigned_ids(pdf: pd.DataFrame) -> pd.DataFrame:
    """seq, gid, tid of the same assignment."""
    both = {(g, t): j for g, t, j in zip(pdf["gid"].tolist(), pdf["tid"].tolist(), pdf["j"].tolist(), strict=True)}
    rows = [(gt[i], trk[k]) for gt, trk, share in _meetings(both) for i, k in zip(*assign(-share), strict=True) if share[i, k] > 0]
    return pd.DataFrame({"seq": pdf["seq"].iloc[0], "gid": [g for g, _ in rows], "tid": [t for _, t in rows]})


def _meetings(both: dict) -> list[tuple[list, list, np.ndarray]]:
    """The values of pairs of ids as matrices, with the ids of their rows and columns, one for each connected part."""
    partners, done, out = {}, set(), []
    for (a, b), n in both.items():
        if n:
            partners.setdefault((0, a), []).append((1, b))
            partners.setdefault((1, b), []).append((0, a))
    for start in partners:
        if start in done:
            continue
        if len(partners[start]) == 1 and len(partners[partners[start][0]]) == 1:  # most parts are one pair
            (_, a), (_, b) = sorted([start, partners[start][0]])
            done.update(((0, a), (1, b)))
            out.append(([a], [b], np.array([[both[a, b]]], float)))
            continue
        done.add(start)
        part, open_ = [start], [start]
        while open_:
            new = [x for x in partners[open_.pop()] if x not in done]
            new = list(dict.fromkeys(new))
            done.update(new)
            part += new
            open_ += new
        sides = [sorted(i for s, i in part if s == k) for k in (0, 1)]
        out.append((*sides, np.array([[both.get((a, b), 0) for b in sides[1]] for a in sides[0]], float)))
    return out


def hota(seq: Sequence) -> list[dict]:
    """Per alpha: TP, FN, FP, and the TP-weighted association, recall, precision and localisation sums."""
    pair = lambda x, y: np.unique(np.stack([x, y]), axis=1, return_inverse=True)
    by_g, by_t = pair(seq.f, seq.g)[1].ravel(), pair(seq.f, seq.t)[1].ravel()
    row, column = np.bincount(by_g, seq.s)[by_g] if len(by_g) else seq.s, np.bincount(by_t, seq.s)[by_t] if len(by_t) else seq.s
    whole = row + column - seq.s
    part = np.where(whole > EPS, seq.s / np.maximum(whole, EPS), 0.0)
    ids, of = pair(seq.g, seq.t)
    of = of.ravel()
    share = np.bincount(of, part, ids.shape[1])
    boxes = np.array([seq.gt[x] + seq.tr[y] for x, y in ids.T.tolist()], float)
    aligned = share / (boxes - share) if len(share) else share
    sims, where = [], []
    index = {k: n for n, k in enumerate(map(tuple, ids.T.tolist()))}
    for (_, _, _, near), (_, _, _, score) in zip(seq.frames(), seq.frames(aligned[of] * seq.s if len(of) else seq.s), strict=True):
        for a, b, block in _meetings(score):
            for r, c in zip(*assign(-block), strict=True) if block.size > 1 else ((0, 0),):
                if (a[r], b[c]) in near:
                    sims.append(near[a[r], b[c]])
                    where.append(index[a[r], b[c]])
    sims, where = np.array(sims), np.array(where, int)
    tp, loc, met = [], [], []
    for alpha in ALPHAS:
        ok = sims >= alpha - EPS
        tp.append(int(ok.sum()))
        loc.append(sims[ok].sum())
        n = np.bincount(where[ok], minlength=ids.shape[1])
        met.append({(x, y): k for (x, y), k in zip(ids.T[n > 0].tolist(), n[n > 0].tolist(), strict=True)})
    ng, nt = sum(seq.gt.values()), sum(seq.tr.values())
    out = []
    for k, alpha in enumerate(ALPHAS):
        a = sum(n * n / (seq.gt[x] + seq.tr[y] - n) for (x, y), n in met[k].items())
        re = sum(n * n / seq.gt[x] for (x, y), n in met[k].items())
        pr = sum(n * n / seq.tr[y] for (x, y), n in met[k].items())
        out.append({"alpha": round(float(alpha), 2), "tp": int(tp[k]), "fn": ng - int(tp[k]), "fp": nt - int(tp[k]), "ass_sum": float(a), "re_sum": float(re), "pr_sum": float(pr), "loc_sum": float(loc[k])})
    return out


def vace(seq: Sequence, least: float = 0.5) -> dict:
    """STDA and ATA of the temporal assignment; FDA summed over frames and their number (SFDA = ratio)."""
    both, fda, used = _together(seq, least), 0.0, len(seq.at)
    frames = defaultdict(set)
    for f, g, t, near in seq.frames():
        for x in g:
            frames["g", x].add(f)
        for x in t:
            frames["t", x].add(f)
        best = sum(float(sim[assign(-sim)].sum()) for _, _, sim in _meetings(near))
        fda += best / (0.5 * (len(g) + len(t))) if g and t else 0.0
    score = {(a, b): n / len(frames["g", a] | frames["t", b]) for (a, b), n in both.items()}
    stda = sum(float(part[assign(-part)].sum()) for _, _, part in _meetings(score))
    return {"stda": stda, "ata": stda / (0.5 * (len(seq.gt) + len(seq.tr))) if seq.gt or seq.tr else float("nan"), "fda": fda, "frames": used}


def id_consistency(seq: Sequence | Passing, least: float = 0.5) -> dict:
    """Mean over matched ground truth ids of the share of matches that their most frequent partner has."""
    held = defaultdict(Counter)
    for _, _, match, _ in _kept(seq, least):
        for a, b in (match or {}).items():
            held[a][b] += 1
    shares = [max(c.values()) / sum(c.values()) for c in held.values()]
    return {"share_sum": float(sum(shares)), "ids": len(shares)}


#: Kinds of accumulator events.
MATCH, SWITCH, TRANSFER, ASCEND, MIGRATE, MISS, FP = "MATCH", "SWITCH", "TRANSFER", "ASCEND", "MIGRATE", "MISS", "FP"


def accumulate(seq: Sequence, least: float = 0.5) -> list[dict]:
    """``events`` as dictionaries."""
    return [dict(zip(("frame", "type", "oid", "hid", "d"), e, strict=True)) for e in events(seq, least)]


def events(seq: Sequence | Passing, least: float = 0.5):
    """Event log (frame, type, oid, hid, d): correspondences are kept from frame to frame while they stay within the limit; the rest is assigned at least distance."""
    held: dict[int, int] = {}
    owner: dict[int, int] = {}
    for f, g, t, near in seq.frames():
        near = {k: s for k, s in near.items() if s >= least}
        free_g, free_t, match = set(g), set(t), {}
        for a in g:
            b = held.get(a)
            if b in free_t and (a, b) in near:
                match[a] = b
                free_g.discard(a)
                free_t.discard(b)
                yield f, MATCH, a, b, 1 - near[a, b]
        found = []
        for x, y, sub in _meetings({(a, b): s for (a, b), s in near.items() if a in free_g and b in free_t}):
            found += [(x[r], y[c]) for r, c in zip(*assign(np.where(sub >= least, 1 - sub, 1e6)), strict=True) if sub[r, c] >= least]
        for a, b in sorted(found):
            switched, taken = a in held and held[a] != b, b in owner and owner[b] != a
            d = 1 - near[a, b]
            yield f, SWITCH if switched else MATCH, a, b, d
            if switched and b not in owner:
                yield f, ASCEND, a, b, d
            if taken:
                yield f, TRANSFER, a, b, d
                if a not in held:
                    yield f, MIGRATE, a, b, d
            match[a] = b
            free_g.discard(a)
            free_t.discard(b)
        held |= match
        owner |= {b: a for a, b in match.items()}
        yield from ((f, MISS, a, None, None) for a in sorted(free_g))
        yield from ((f, FP, None, b, None) for b in sorted(free_t))


#: Kernels that take the frames of a sequence once, and hold what they need of those before.
BY_FRAME = (clear, id_consistency, events)


def mean_path_share(seq: Sequence, frame: np.ndarray, gid: np.ndarray, x: np.ndarray, y: np.ndarray, least: float = 0.5) -> float:
    """Matched share of the ground truth's path length (IDEucl). x, y: where ``gid`` is in ``frame``; repeats are alike."""
    # Of equally good partners those win that come first in the order of appearance.
    rank = [dict(zip(dict.fromkeys(i.tolist()), range(len(i)), strict=False)) for _, i in seq.own]
    name = [list(r) for r in rank]
    both = {(rank[0][a], rank[1][b]): n for (a, b), n in _together(seq, least).items()}
    partner = {name[0][a[r]]: name[1][b[c]] for a, b, n in _meetings(both) for r, c in zip(*assign(-n), strict=True) if n[r, c]}
    key = lambda g, f: np.searchsorted(ids, g) * len(seq.at) + np.searchsorted(seq.at, f)
    ids = np.array(list(seq.gt))
    own = np.array([partner.get(a, -1) for a in ids.tolist()])
    on = (seq.s >= least) & np.isin(seq.g, list(partner))
    on[on] = own[np.searchsorted(ids, seq.g[on])] == seq.t[on]
    spots, first = np.unique(key(gid, frame), return_index=True)
    x, y, gid = x[first], y[first], gid[first]
    ok = np.isin(spots, key(seq.g[on], seq.f[on]))
    step = np.where(gid[1:] == gid[:-1], np.hypot(np.diff(x), np.diff(y)), 0.0)
    whole = float(step.sum())
    return float(step[ok[1:] & ok[:-1]].sum()) / whole if whole else 0.0
