"""Least-cost transport between two small distributions of equal mass, by prices."""

from __future__ import annotations

import numpy as np

EPS = 1e-12


class Plan:
    """Prices and flow of one problem. Mass moves only where the cost less both prices is zero;
    when no such path to a place in need is left, prices rise by the shortest paths over what
    costs remain, up to the nearest such place."""

    def __init__(self, a: np.ndarray, b: np.ndarray, cost: np.ndarray):
        self.left, self.need, self.cost = np.array(a, float), np.array(b, float), np.asarray(cost, float)
        self.flow = np.zeros(self.cost.shape)
        self.rest = self.cost - self.cost.min(axis=1, keepdims=True) if self.cost.size else self.cost.copy()
        self.tiny = EPS * max(1.0, self.left.sum())
        self.free = EPS * max(1.0, self.cost.max(initial=0.0))
        self.routes = self.rises = 0
        self._direct()
        while self._open():
            if not self._route():
                self._rise()

    @property
    def total(self) -> float:
        return float((self.flow * self.cost).sum())

    def _open(self) -> bool:
        return bool((self.left > self.tiny).any() and (self.need > self.tiny).any())

    def _direct(self) -> None:
        """Mass that moves to a place in one free step."""
        for i, j in np.argwhere(self.rest <= self.free):
            amount = min(self.left[i], self.need[j])
            if amount > self.tiny:
                self.flow[i, j] += amount
                self.left[i] -= amount
                self.need[j] -= amount
                self.routes += 1

    def _route(self) -> bool:
        """Send mass along one free path, which may take back what was sent before; False if there is none."""
        free = self.rest <= self.free
        rows, cols = self.left > self.tiny, np.zeros(len(self.need), bool)
        via, back = np.full(len(self.need), -1), np.full(len(self.left), -1)
        wave = rows.copy()
        while wave.any():
            hit = free & wave[:, None]
            new = hit.any(axis=0) & ~cols
            via[new] = hit.argmax(axis=0)[new]
            cols |= new
            ends = np.flatnonzero(new & (self.need > self.tiny))
            if len(ends):
                self._push(int(ends[0]), via, back)
                return True
            home = (self.flow > self.tiny) & new[None, :]
            wave = home.any(axis=1) & ~rows
            back[wave] = home.argmax(axis=1)[wave]
            rows |= wave
        return False

    def _push(self, end: int, via: np.ndarray, back: np.ndarray) -> None:
        steps, j, amount = [], end, self.need[end]
        while True:
            i = via[j]
            steps.append((i, j, 1.0))
            if back[i] < 0:
                break
            amount = min(amount, self.flow[i, back[i]])
            steps.append((i, back[i], -1.0))
            j = back[i]
        amount = min(amount, self.left[i])
        for p, q, sign in steps:
            self.flow[p, q] += sign * amount
        self.left[i] -= amount
        self.need[end] -= amount
        self.routes += 1

    def _rise(self) -> None:
        """Shortest paths over what costs remain, from all places with mass left; steps back are free."""
        row = np.where(self.left > self.tiny, 0.0, np.inf)
        used = self.flow > self.tiny
        while True:
            col = (row[:, None] + self.rest).min(axis=0)
            new = np.minimum(row, np.where(used, col[None, :], np.inf).min(axis=1))
            if (new >= row - self.free).all():
                break
            row = new
        most = col[self.need > self.tiny].min()
        self.rest += np.minimum(row, most)[:, None] - np.minimum(col, most)[None, :]
        np.maximum(self.rest, 0.0, out=self.rest)
        self.rises += 1


def transport_cost(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving masses a to masses b of the same sum."""
    return Plan(a, b, cost).total
