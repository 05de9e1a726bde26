"""Replay of users' reactions under many configurations at once (the step of F10).

The state is arrays: a column for each run (a configuration under one preference profile) and a
row for each profile slot. One reaction is one step of all runs: one product gives its cosine
with every vector that any slot holds, draws are made for the runs that need one, and the
accepted runs go through decay, first match, eviction and the softmax update side by side. The
only loop within a step is over slots, because the softmax is recomputed between their updates.

``Lanes`` steps many users at once: its columns are the runs of all of them, each user's with its
own reaction, so the cost of a step is shared. ``Replay`` takes one user's reactions as they come,
for histories that are too long to be held.

Slots refer to unit vectors in one store, so a vector that many runs hold is kept and compared
once. The store is compacted as it grows; it never holds more than the slots can refer to, plus
a constant.
"""

from __future__ import annotations

import numpy as np

from prefspark.functions.draws import py_uniform_text, py_uniforms
from prefspark.operators.profile import DECAY

PARAMS = ["alpha", "gamma", "beta", "max_embeddings", "exp_rate", "n_components"]
STORE_SLACK = 1024  # vectors that the store may hold beyond twice the slots before it is compacted


class _Runs:
    """Columns of runs: the state of each, and what a reaction does to it."""

    min_samples: int
    decay: float
    errors: dict[int, str]

    def _empty(self, runs: int) -> None:
        self.runs = runs
        self.prefs, self.counts, self.rows = np.zeros((0, runs)), np.zeros((0, runs)), np.zeros((0, runs), np.int64)
        self.m = np.zeros(runs, np.int64)
        self.avg, self.total, self.failed = np.zeros(runs), np.zeros(runs), np.zeros(runs, bool)

    def _slots(self, n: int) -> None:
        """Room for ``n`` slots."""
        if n > len(self.prefs):
            more = max(n, 2 * len(self.prefs), 4) - len(self.prefs)
            self.prefs, self.counts, self.rows = (np.concatenate([a, np.zeros((more, self.runs), a.dtype)]) for a in (self.prefs, self.counts, self.rows))

    def _chosen(self, runs: np.ndarray, u: np.ndarray, w: int, valid: np.ndarray) -> np.ndarray:
        """Slot of each run by its draw from the softmax of upper bounds; the last slot guards round-off."""
        counts = np.where(valid, self.counts[:w, runs], 1.0)
        bound = np.where(valid, self.beta[runs] * np.log(self.total[runs]) / counts + self.prefs[:w, runs], -np.inf)
        z = np.exp(bound - bound.max(axis=0))
        above = np.cumsum(z / z.sum(axis=0), axis=0) > u
        return np.where(above.any(axis=0), above.argmax(axis=0), self.m[runs] - 1)

    def _react(self, runs: np.ndarray, reward: np.ndarray, near: np.ndarray, row: int) -> bool:
        """Decay, then update the first similar slot or a new one, which refers to vector ``row``; whether there is a new one."""
        w, m = len(near), self.m[runs]
        prefs, counts, rows = self.prefs[:w, runs] * self.decay, self.counts[:w, runs], self.rows[:w, runs]
        hit = near >= self.gamma[runs]
        slot = hit.argmax(axis=0) if w else np.zeros(len(runs), np.int64)
        new = ~hit.any(axis=0)
        full = np.flatnonzero(new & (m > self.most[runs]))
        if len(full):
            at = self._victims(prefs[:, full], counts[:, full], m[full], self.beta[runs[full]])
            take = np.minimum(np.arange(w)[:, None] + (np.arange(w)[:, None] >= at), w - 1)
            for a in (prefs, counts, rows):
                a[:, full] = np.take_along_axis(a[:, full], take, axis=0)
            m[full] -= 1
        if new.any():
            least = int(m[new].max()) + 1
            self._slots(least)
            if least > w:
                prefs, counts, rows = (np.concatenate([a, np.zeros((least - w, len(runs)), a.dtype)]) for a in (prefs, counts, rows))
            at = np.flatnonzero(new)
            prefs[m[at], at], counts[m[at], at], rows[m[at], at] = 0.0, 0.0, row
            slot[at] = m[at]
            m[at] += 1
        sound = self._update(prefs, m, slot, self.alpha[runs] * (reward - self.avg[runs]))
        counts[slot, np.arange(len(runs))] += 1
        w = len(prefs)
        self.prefs[:w, runs], self.counts[:w, runs], self.rows[:w, runs], self.m[runs] = prefs, counts, rows, m
        self.total[runs] += 1
        self.avg[runs] += (reward - self.avg[runs]) / self.total[runs]
        if not sound.all():
            self._fail(runs[~sound], "OverflowError: preferences beyond the range of doubles")
        return bool(new.any())

    def _victims(self, prefs: np.ndarray, counts: np.ndarray, m: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """The slot with the least lower bound among those with enough samples, else the least preference."""
        valid = np.arange(len(prefs))[:, None] < m
        sampled = valid & (counts >= self.min_samples)
        bound = np.where(sampled, prefs - beta * np.sqrt(1.0 / np.maximum(counts, 1.0)), np.inf)
        return np.where(sampled.any(axis=0), bound, np.where(valid, prefs, np.inf)).argmin(axis=0)

    @staticmethod
    def _update(prefs: np.ndarray, m: np.ndarray, slot: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Gradient step in place, slot after slot, each with the softmax of the values as they stand; whether all stayed finite."""
        valid = np.arange(len(prefs))[:, None] < m
        shift = np.where(valid, prefs, -np.inf).max(axis=0)
        ex = np.where(valid, np.exp(prefs - shift), 0.0)
        total = ex.sum(axis=0)
        for i in range(len(prefs)):
            old = ex[i]
            value = prefs[i] + step * ((slot == i) - old / total)
            e = np.where(valid[i], np.exp(value - shift), 0.0)
            prefs[i] = value
            dominant = old > 0.5 * total  # taking a dominant term away loses precision: add up again
            total = total - old + e
            ex[i] = e
            if dominant.any():
                total = np.where(dominant, ex.sum(axis=0), total)
        return np.isfinite(total) & (total > 0) & np.isfinite(prefs).all(axis=0)

    def _fail(self, runs: np.ndarray, error: str) -> None:
        self.failed[runs] = True
        self.errors.update(dict.fromkeys(runs.tolist(), error))

class Replay(_Runs):
    """Runs of one user. ``params``: a row of PARAMS for each configuration."""

    def __init__(self, config_ids: list[int], params: np.ndarray, prefix: list[str], min_samples: int, decay: float = DECAY):
        self.config_ids, self.prefix = config_ids, prefix  # key prefixes of the draws, one for each configuration
        self.given = np.asarray(params, np.float64).T
        self.min_samples, self.decay = min_samples, decay
        self.profiles: dict[str, int] = {}
        self.tallies: dict[str | None, np.ndarray] = {}  # category -> events, accepted, sum and sum of squares of rewards, by run
        self.errors: dict[int, str] = {}
        self.n_stored = 0
        self.units: dict[int, np.ndarray] = {}  # components -> unit vectors
        self.length: int | None = None
        wanted = self.given[5].astype(np.int64)
        self.sizes = sorted(set(wanted.tolist()))
        self.size_of = np.searchsorted(self.sizes, wanted)
        self._empty(0)

    # -- layout -------------------------------------------------------------
    def _add_profile(self, name: str) -> None:
        """Runs of one more preference profile, all empty."""
        n = len(self.config_ids)
        self.profiles[name] = len(self.profiles)
        self.runs += n
        wider = lambda a: np.concatenate([a, np.zeros((len(a), n), a.dtype)], axis=1)
        longer = lambda a: np.concatenate([a, np.zeros(n, a.dtype)])
        self.prefs, self.counts, self.rows = wider(self.prefs), wider(self.counts), wider(self.rows)
        self.m, self.avg, self.total, self.failed = longer(self.m), longer(self.avg), longer(self.total), longer(self.failed)
        self.tallies = {c: wider(t) for c, t in self.tallies.items()}
        times = len(self.profiles)
        self.alpha, self.gamma, self.beta, self.most, self.rate, _ = np.tile(self.given, times)
        self.size = np.tile(self.size_of, times)

    def _store(self, vec: np.ndarray) -> np.ndarray:
        """Put ``vec`` at the store's end; its cosine with all stored vectors, one row for each number of components."""
        sims = np.zeros((len(self.sizes), self.n_stored + 1))
        for k, size in enumerate(self.sizes):
            v = vec[:size] if 0 < size < len(vec) else vec
            norm = float(np.sqrt(v @ v))
            unit = v / norm if norm != 0 else v
            held = self.units.get(size)
            if held is None or self.n_stored >= len(held):
                grown = np.zeros((max(64, 2 * self.n_stored), len(unit)))
                if held is not None:
                    grown[: len(held)] = held
                held = self.units[size] = grown
            held[self.n_stored] = unit
            sims[k] = held[: self.n_stored + 1] @ unit
        return sims

    def _compact(self) -> None:
        """Drop the vectors that no slot refers to."""
        filled = np.arange(len(self.rows))[:, None] < self.m[None, :]
        live, place = np.unique(self.rows[filled], return_inverse=True)
        self.rows[filled] = place
        for size, held in self.units.items():
            held[: len(live)] = held[live]
        self.n_stored = len(live)

    # -- one reaction -------------------------------------------------------
    def step(self, vec: np.ndarray, event_id: int, category: str | None, rewards: dict[str, float]) -> None:
        for name in rewards:
            if name not in self.profiles:
                self._add_profile(name)
        reward = np.full(self.runs, np.nan)
        n = len(self.config_ids)
        for name, value in rewards.items():
            reward[self.profiles[name] * n : (self.profiles[name] + 1) * n] = value
        on = ~self.failed & ~np.isnan(reward)
        tally = self.tallies.get(category)
        if tally is None:
            tally = self.tallies[category] = np.zeros((4, self.runs))
        tally[0, on] += 1
        if self.length is None:
            self.length = len(vec)
        if len(vec) != self.length:
            self._fail(np.flatnonzero(on), f"ValueError: vector of {len(vec)} dimensions among vectors of {self.length}")
            return
        sims = self._store(vec)
        w = int(self.m.max(initial=0))
        valid = np.arange(w)[:, None] < self.m[None, :]
        near = np.where(valid, sims[self.size[None, :], self.rows[:w]], -np.inf)
        accept = on.copy()
        asked = np.flatnonzero(on & (self.m > 0) & ~self._explores(event_id))
        if len(asked):
            accept[asked] = near[self._drawn(asked, event_id, w, valid[:, asked]), asked] >= self.gamma[asked]
        taken = np.flatnonzero(accept)
        if not len(taken):
            return
        with np.errstate(all="ignore"):
            self.n_stored += self._react(taken, reward[taken], near[:, taken], self.n_stored)
        taken = taken[~self.failed[taken]]
        tally[1, taken] += 1
        tally[2, taken] += reward[taken]
        tally[3, taken] += reward[taken] ** 2
        if self.n_stored > 2 * int(self.m.sum()) + STORE_SLACK:
            self._compact()

    def _draws(self, configs: np.ndarray, event_id: int, what: str) -> np.ndarray:
        """Keyed draws of some configurations; the profiles share them."""
        out = np.ones(len(self.config_ids))
        out[configs] = [py_uniform_text(f"{self.prefix[c]}{event_id}:{what}") for c in configs.tolist()]
        return out

    def _explores(self, event_id: int) -> np.ndarray:
        rate = self.given[4]
        explores = self._draws(np.flatnonzero((rate > 0) & (rate < 1)), event_id, "gate") < rate  # a draw is below 1
        return np.tile(explores | (rate >= 1), len(self.profiles))

    def _drawn(self, runs: np.ndarray, event_id: int, w: int, valid: np.ndarray) -> np.ndarray:
        """Slot of each run by its keyed draw."""
        configs = runs % len(self.config_ids)
        u = self._draws(np.unique(configs), event_id, "slot")[configs]
        return self._chosen(runs, u, w, valid)

    # -- results ------------------------------------------------------------
    def sums(self) -> dict[tuple[str, str | None], np.ndarray]:
        """(profile, category) -> events, accepted, sum and sum of squares of rewards (rows) of each configuration."""
        n = len(self.config_ids)
        return {(name, c): tally[:, k * n : (k + 1) * n] for c, tally in self.tallies.items() for name, k in self.profiles.items()}

    def failures(self) -> dict[tuple[str, int], str]:
        """(profile, place of the configuration) -> error."""
        n, names = len(self.config_ids), list(self.profiles)
        return {(names[run // n], run % n): error for run, error in self.errors.items()}


class Lanes(_Runs):
    """Runs of many users, each with all of its reactions (vec, event_id, category, rewards) in order.

    A step is the next reaction of every user that still has one. ``prefix``: key prefixes of the
    draws for each user and configuration. A user's vectors have one length. ``rows`` are the places
    of the users' own reactions, so there is no store to keep.
    """

    def __init__(self, config_ids: list[int], params: np.ndarray, prefix: list[list[str]], users: list[list[tuple]], min_samples: int, decay: float = DECAY):
        by_length = sorted(range(len(users)), key=lambda i: -len(users[i]))  # those that still have reactions come first
        self.config_ids, self.users, self.prefix = config_ids, [users[i] for i in by_length], [prefix[i] for i in by_length]
        self.min_samples, self.decay, self.errors = min_samples, decay, {}
        given = np.asarray(params, np.float64).T
        self.profiles = sorted({name for events in self.users for *_, rewards in events for name in rewards})
        n, lanes, times = len(config_ids), len(users), len(users) * len(self.profiles)
        self._empty(times * n)
        self.alpha, self.gamma, self.beta, self.most, self.rate, _ = np.tile(given, times)
        self.gate = given[4]
        self.lane = np.repeat(np.arange(lanes), len(self.profiles) * n)
        self.config = np.tile(np.arange(n), times)
        wanted = given[5].astype(np.int64)
        self.sizes = sorted(set(wanted.tolist()))
        self.size = np.tile(np.searchsorted(self.sizes, wanted), times)
        steps = max(map(len, self.users), default=0)
        self.on, self.taken = np.zeros((steps, self.runs), bool), np.zeros((steps, self.runs), bool)
        self.reward = np.full((steps, lanes, len(self.profiles)), np.nan)
        places = {name: k for k, name in enumerate(self.profiles)}
        for lane, events in enumerate(self.users):
            for t, (*_, rewards) in enumerate(events):
                for name, value in rewards.items():
                    self.reward[t, lane, places[name]] = value
        self.units = [self._units(size, steps) for size in self.sizes]
        self._play(steps)

    def _units(self, size: int, steps: int) -> np.ndarray:
        """Unit vectors (user, reaction) of the first ``size`` components; zero vectors stay zero."""
        widest = max((len(events[0][0]) for events in self.users if events), default=0)
        out = np.zeros((len(self.users), steps, widest))
        for lane, events in enumerate(self.users):
            v = np.stack([vec for vec, *_ in events])
            v = v[:, :size] if 0 < size < v.shape[1] else v
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            out[lane, : len(v), : v.shape[1]] = v / np.where(norm == 0, 1.0, norm)[:, None]
        return out

    def _play(self, steps: int) -> None:
        lengths = np.array([len(events) for events in self.users])
        n, gated = len(self.config_ids), np.flatnonzero((self.gate > 0) & (self.gate < 1)).tolist()
        for t in range(steps):
            lanes = int((lengths > t).sum())
            active = lanes * len(self.profiles) * n
            ids = [events[t][1] for events in self.users[:lanes]]
            reward = np.repeat(self.reward[t, :lanes].ravel(), n)
            on = self.on[t, :active] = ~self.failed[:active] & ~np.isnan(reward)
            w = int(self.m[:active].max(initial=0))
            valid = np.arange(w)[:, None] < self.m[:active]
            near = np.full((w, active), -np.inf)
            if w:
                sims = np.stack([np.matmul(u[:lanes, : t + 1], u[:lanes, t, :, None])[:, :, 0] for u in self.units])
                at = (self.size[:active] * lanes + self.lane[:active]) * (t + 1)
                near = np.where(valid, sims.ravel()[at + np.where(valid, self.rows[:w, :active], 0)], -np.inf)
            draw = np.ones((lanes, n))
            draw[:, gated] = py_uniforms([f"{self.prefix[lane][c]}{event}:gate" for lane, event in enumerate(ids) for c in gated]).reshape(lanes, len(gated))
            explores = (draw < self.gate) | (self.gate >= 1)
            asked = np.flatnonzero(on & (self.m[:active] > 0) & ~explores[self.lane[:active], self.config[:active]])
            accept = on.copy()
            if len(asked):
                which, back = np.unique(self.lane[asked] * n + self.config[asked], return_inverse=True)
                u = py_uniforms([f"{self.prefix[k // n][k % n]}{ids[k // n]}:slot" for k in which.tolist()])[back]
                accept[asked] = near[self._chosen(asked, u, w, valid[:, asked]), asked] >= self.gamma[asked]
            taken = np.flatnonzero(accept)
            if len(taken):
                with np.errstate(all="ignore"):
                    self._react(taken, reward[taken], near[:, taken], t)
                self.taken[t, taken[~self.failed[taken]]] = True

    def _by_profile(self, per_run: np.ndarray) -> np.ndarray:
        return per_run.reshape(len(per_run), len(self.users), len(self.profiles), len(self.config_ids))

    def sums(self) -> dict[tuple[str, str | None], np.ndarray]:
        """(profile, category) -> events, accepted, sum and sum of squares of rewards (rows) of each configuration, over all users."""
        at: dict[str | None, list[tuple[int, int]]] = {}
        for lane, events in enumerate(self.users):
            for t, (_, _, category, _) in enumerate(events):
                at.setdefault(category, []).append((t, lane))
        on, taken, out = self._by_profile(self.on), self._by_profile(self.taken), {}
        for category, places in at.items():
            t, lane = np.array(places).T
            for k, name in enumerate(self.profiles):
                met, got = on[t, lane, k], taken[t, lane, k]
                reward = np.where(got, self.reward[t, lane, k][:, None], 0.0)
                out[name, category] = np.stack([met.sum(0), got.sum(0), reward.sum(0), (reward**2).sum(0)])
        return out

    def failures(self) -> dict[tuple[str, int], str]:
        """(profile, place of the configuration) -> error of one of the users."""
        n, out = len(self.config_ids), {}
        for run, error in self.errors.items():
            key = self.profiles[run // n % len(self.profiles)], run % n
            out[key] = max(error, out.get(key, error))
        return out
