"""Optimal one-to-one assignment of two small point sets per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def assign_many(cost: np.ndarray) -> np.ndarray:
    """For each matrix of a stack (k, n, m), n <= m, the column of every row in its assignment of least cost.

    Shortest augmenting paths with potentials, all matrices in step: row by row, a search goes on in those that have not
    reached a free column yet.
    """
    k, n, m = cost.shape
    u, v = np.zeros((k, n + 1)), np.zeros((k, m + 1))
    owner = np.zeros((k, m + 1), int)  # column 0 holds the row that is being placed
    for i in range(1, n + 1):
        owner[:, 0] = i
        at, best, back = np.zeros(k, int), np.full((k, m + 1), np.inf), np.zeros((k, m + 1), int)
        done = np.zeros((k, m + 1), bool)
        go = np.arange(k)
        while len(go):
            done[go, at[go]] = True
            row = owner[go, at[go]]
            slack = cost[go, row - 1] - u[go, row][:, None] - v[go, 1:]
            free = ~done[go, 1:]
            closer = free & (slack < best[go, 1:])
            best[go, 1:] = np.where(closer, slack, best[go, 1:])
            back[go, 1:] = np.where(closer, at[go][:, None], back[go, 1:])
            reach = np.where(free, best[go, 1:], np.inf)
            nearest = reach.argmin(1)
            step = reach[np.arange(len(go)), nearest][:, None]
            raised = np.zeros((len(go), n + 1))
            np.put_along_axis(raised, np.where(done[go], owner[go], 0), np.where(done[go], step, 0.0), 1)
            raised[:, 0] = 0
            u[go] += raised
            v[go] -= np.where(done[go], step, 0.0)
            best[go] -= np.where(done[go], 0.0, step)
            at[go] = nearest + 1
            go = go[owner[go, at[go]] != 0]
        go = np.arange(k)
        while len(go):
            was = back[go, at[go]]
            owner[go, at[go]] = owner[go, was]
            at[go] = was
            go = go[was != 0]
    chosen = np.zeros((k, n + 1), int)
    np.put_along_axis(chosen, owner[:, 1:], np.broadcast_to(np.arange(m), (k, m)), 1)
    return chosen[:, 1:]


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the assignment of least cost."""
    flipped = cost.shape[0] > cost.shape[1]
    columns = assign_many((cost.T if flipped else cost)[None])[0].tolist()
    return sorted((b, a) if flipped else (a, b) for a, b in enumerate(columns))


def matched_distances(batches: Iterator[pd.DataFrame], gate: float) -> Iterator[pd.DataFrame]:
    """mapInPandas body: columns frame, ax, ay, bx, by (arrays) to one row per accepted pair; frames of one size are solved together."""
    for pdf in batches:
        sizes = pdf.ax.str.len().to_numpy(), pdf.bx.str.len().to_numpy()
        for n, m in set(zip(*sizes)):
            if not n or not m:
                continue
            some = pdf[(sizes[0] == n) & (sizes[1] == m)]
            ax, ay, bx, by = (np.stack(some[c].to_numpy()) for c in ("ax", "ay", "bx", "by"))
            d = np.hypot(ax[:, :, None] - bx[:, None, :], ay[:, :, None] - by[:, None, :])
            columns = assign_many(d if n <= m else d.transpose(0, 2, 1))
            rows = np.broadcast_to(np.arange(columns.shape[1]), columns.shape)
            a, b = (rows, columns) if n <= m else (columns, rows)
            frame = np.broadcast_to(np.arange(len(some))[:, None], a.shape)
            err = d[frame, a, b]
            near = err <= gate
            yield pd.DataFrame({"frame": some["frame"].to_numpy()[frame[near]], "a": a[near], "b": b[near], "err": err[near]})


class TrackSet:
    """Tracks of one group as arrays, a row each: number, place, velocity, time and steps since the last sighting.

    A sighting is taken for a track if it is assigned to it and lies within ``gate``, widened by one for every step the
    track went unseen. Tracks unseen for more than ``patience`` steps end.
    """

    # Share of a new velocity, its limit per axis, and how far ahead a place is predicted, in seconds.
    BLEND, LIMIT, AHEAD = 0.4, 10.0, 0.5

    def __init__(self, gate: float = 2.5, patience: int = 10):
        self.gate, self.patience, self.opened = gate, patience, 0
        self.number, self.unseen = np.zeros(0, int), np.zeros(0, int)
        self.place, self.velocity, self.time = np.zeros((0, 2)), np.zeros((0, 2)), np.zeros(0)

    def step(self, t: float, points: np.ndarray) -> np.ndarray:
        """Track number for every point at time ``t``."""
        since = t - self.time
        expected = self.place + self.velocity * np.minimum(since, self.AHEAD)[:, None]
        apart = np.linalg.norm(expected[:, None, :] - points[None, :, :], axis=2)
        who, what = np.array(assign(apart) if apart.size else [], int).reshape(-1, 2).T
        near = apart[who, what] <= self.gate + self.unseen[who]
        who, what = who[near], what[near]
        moved = np.clip((points[what] - self.place[who]) / np.maximum(since[who], 1e-3)[:, None], -self.LIMIT, self.LIMIT)
        self.velocity[who] += self.BLEND * (moved - self.velocity[who])
        self.place[who], self.time[who] = points[what], t
        self.unseen += 1
        self.unseen[who] = 0
        label = np.full(len(points), -1)
        label[what] = self.number[who]
        new = np.flatnonzero(label < 0)
        label[new] = self.opened + np.arange(len(new))
        self.opened += len(new)
        stay, nothing = self.unseen <= self.patience, np.zeros(len(new))
        self.number = np.append(self.number[stay], label[new])
        self.unseen = np.append(self.unseen[stay], nothing.astype(int))
        self.time = np.append(self.time[stay], nothing + t)
        self.place = np.concatenate([self.place[stay], points[new]])
        self.velocity = np.concatenate([self.velocity[stay], np.zeros((len(new), 2))])
        return label


def track_numbers(i: np.ndarray, t: np.ndarray, points: np.ndarray, gate: float) -> np.ndarray:
    """Track number for every point of groups that follow each other; ``i`` counts from 1 in each, ``t`` rises.

    The points of a group's first time open a track each, in their order; only groups that go on need a tracker.
    """
    number = i - 1
    starts = np.flatnonzero(i == 1)
    ends = np.append(starts[1:], len(i))
    for a, z in zip(starts, ends):
        if t[a] == t[z - 1]:
            continue
        tracks, own = TrackSet(gate=gate), t[a:z]
        cuts = [a, *(a + 1 + np.flatnonzero(own[1:] != own[:-1])), z]
        for b, c in zip(cuts, cuts[1:]):
            number[b:c] = tracks.step(float(t[b]), points[b:c])
    return number
