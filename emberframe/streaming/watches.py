"""Timed machines: silent sources, stream gaps, soak sessions, the quota protocol and the attempt loop."""

from __future__ import annotations

from dataclasses import dataclass
from math import hypot
from statistics import median

from emberframe.operators.tracking import advance
from emberframe.streaming.machines import PairFreshness, PressureEstimator, SoakMonitor
from emberframe.streaming.timed import TimedMachine


@dataclass(frozen=True)
class SilenceWatch(TimedMachine):
    """Publications of a source; a stall or a read error is reported once a publication.

    Rows have kind: ``start`` (the source begins), ``frame`` or ``error``. A frame and an error are a new
    generation. Longer than ``limit_us`` without one: thermal_stale, or thermal_unavailable where no frame has
    come since the start.
    """

    limit_us: int
    state = "generation long, heard_us long, observed boolean, reported boolean"
    output = "generation long, report string"

    def initial(self):
        return {"generation": 0, "heard_us": None, "observed": False, "reported": False}

    def due(self, state):
        return None if state["reported"] or state["heard_us"] is None else state["heard_us"] + self.limit_us + 1

    def on_time(self, state, at):
        report = "thermal_stale" if state["observed"] else "thermal_unavailable"
        return {**state, "reported": True}, [(state["generation"], report)]

    def on_row(self, state, at, row):
        if row["kind"] == "start":
            return {**state, "heard_us": at, "observed": False, "reported": False}, []
        failed = row["kind"] == "error"
        generation = state["generation"] + 1
        new = {"generation": generation, "heard_us": at, "observed": state["observed"] or not failed, "reported": failed}
        return new, [(generation, "thermal_unavailable")] if failed else []


@dataclass(frozen=True)
class GapWatch(TimedMachine):
    """A gap for each ``period_us`` without a frame; after ``limit`` in a row the stream is given up."""

    period_us: int
    limit: int = 15
    state = "heard_us long, gaps long, lost boolean"
    output = "event string, gaps_in_row long"

    def initial(self):
        return {"heard_us": None, "gaps": 0, "lost": False}

    def due(self, state):
        return None if state["lost"] else state["heard_us"] + (state["gaps"] + 1) * self.period_us + 1

    def on_time(self, state, at):
        gaps = state["gaps"] + 1
        lost = gaps >= self.limit
        out = [("stream_gap", gaps), *([("stream_lost", gaps)] if lost else [])]
        return {**state, "gaps": gaps, "lost": lost}, out

    def on_row(self, state, at, row):
        return state if state["lost"] else {"heard_us": at, "gaps": 0, "lost": False}, []


@dataclass(frozen=True)
class SoakWatch(TimedMachine):
    """The soak monitor with its own clock: a source that stops ticking ends the session by itself.

    Rows are ticks as ``SoakMonitor`` takes them, but with times in microseconds (observed_us).
    """

    stall_us: int
    close: float = 0.045
    reopen: float = 0.055
    state = "start long, id long, seen long, latched boolean, ended string, wait string, cycles long"
    output = "state string, cycles long, fault_latched boolean, terminal_reason string"

    def _monitor(self) -> SoakMonitor:
        return SoakMonitor(self.stall_us, self.close, self.reopen)

    def initial(self):
        return self._typed(self._monitor().initial())

    @staticmethod
    def _typed(s: dict) -> dict:
        return {"start": s["start"], "id": s["id"], "seen": s["seen"], "latched": s["latched"], "ended": s["end"],
                "wait": s["counter"]["wait"], "cycles": s["counter"]["cycles"]}

    def due(self, state):
        heard = state["start"] if state["seen"] is None else state["seen"]
        return None if state["ended"] is not None or heard is None else heard + self.stall_us + 1

    def on_time(self, state, at):
        ended = "oak_no_first_frame_stall" if state["seen"] is None else "oak_publication_stall"
        return {**state, "ended": ended}, [(None, state["cycles"], state["latched"], ended)]

    def on_row(self, state, at, row):
        if state["ended"] is not None:
            return state, []
        own = {"start": state["start"], "id": state["id"], "seen": state["seen"], "latched": state["latched"], "end": None,
               "counter": {"wait": state["wait"], "cycles": state["cycles"]}}
        new, out = self._monitor().step(own, {**row, "now_s": at, "observed_s": row["observed_us"]})
        return self._typed(new), [out]


@dataclass(frozen=True)
class QuotaWatch(TimedMachine):
    """Groups of touch, press and return, each a quota of accepted samples within a time limit.

    Rows have event (``unlock``, ``space`` or ``sample`` with centre u, v). A recording phase that reaches
    ``timeout_us`` invalidates its group, also when nothing arrives any more; the next group follows, or the
    protocol is blocked with ``stop_on_timeout``.
    """

    groups: int = 6
    quota: int = 5
    timeout_us: int = 10_000_000
    stop_on_timeout: bool = False
    state = "phase string, grp long, n long, us array<double>, vs array<double>, base_u double, base_v double, since_us long"
    output = (
        "event string, phase string, group_index long, quota_accepted boolean, valid_samples long, "
        "center_shift_px double, group_completed boolean"
    )

    def initial(self):
        return self._group("warmup", None)

    @staticmethod
    def _group(phase: str, grp: int | None) -> dict:
        return {"phase": phase, "grp": grp, "n": 0, "us": [], "vs": [], "base_u": None, "base_v": None, "since_us": None}

    def _closed(self, state: dict, stop: bool) -> dict:
        """After a group: rest, or the end."""
        phase = "blocked" if stop else "complete" if state["grp"] + 1 >= self.groups else "rest"
        return {**state, "phase": phase, "grp": state["grp"] if phase == "rest" else None, "n": 0, "since_us": None}

    def due(self, state):
        return None if state["since_us"] is None else state["since_us"] + self.timeout_us

    def _said(self, event, state, accepted=False, n=None, shift=None, completed=False):
        return [(event, state["phase"], state["grp"], accepted, state["n"] if n is None else n, shift, completed)]

    def on_time(self, state, at):
        new = self._closed(state, self.stop_on_timeout)
        return new, self._said("timeout", new)

    def on_row(self, state, at, row):
        event, phase = row["event"], state["phase"]
        if event == "unlock" and phase == "warmup":
            new = self._group("prepare_just_touch", 0)
        elif event == "space" and phase.startswith("prepare_"):
            new = {**state, "phase": phase.replace("prepare_", "record_"), "n": 0, "since_us": at}
        elif event == "space" and phase == "rest":
            new = self._group("prepare_just_touch", state["grp"] + 1)
        elif event == "sample" and phase.startswith("record_"):
            return self._sample(state, row)
        else:
            new = state
        return new, self._said(event, new)

    def _sample(self, state, row):
        u, v, n = row["u"], row["v"], state["n"] + 1
        first = state["phase"] == "record_just_touch"
        shift = None if first else hypot(u - state["base_u"], v - state["base_v"])
        new = {**state, "n": n}
        if first:
            new |= {"us": [*state["us"], u], "vs": [*state["vs"], v]}
        completed = False
        if n >= self.quota:
            completed = state["phase"] == "record_return_touch"
            if completed:
                new = self._closed(new, False)
            elif first:
                new |= {"phase": "prepare_press_hard", "base_u": float(median(new["us"])), "base_v": float(median(new["vs"]))}
            else:
                new |= {"phase": "prepare_return_touch"}
            new |= {"n": 0, "since_us": None}
        return new, self._said("sample", new, True, n, shift, completed)


@dataclass(frozen=True)
class AttemptWatch(TimedMachine):
    """Approach until the value has stayed in tolerance, hold, else try again: the events of one step.

    Rows have value. The target must be held for ``stable_us`` within ``reach_us`` of the attempt's begin; in
    the hold, values may be out of tolerance for ``gap_us``; after ``hold_us`` the step is complete. An attempt
    that runs out of time ends by its timer and the next begins at once.
    """

    target: float
    tolerance: float
    stable_us: int
    reach_us: int
    gap_us: int
    hold_us: int
    attempts: int
    state = "attempt long, mode string, began_us long, in_us long, out_us long"
    output = "attempt long, event string, reason string"

    def initial(self):
        return {"attempt": 0, "mode": "new", "began_us": None, "in_us": None, "out_us": None}

    def _begin(self, attempt: int, at: int):
        if attempt > self.attempts:
            return {"attempt": self.attempts, "mode": "failed", "began_us": None, "in_us": None, "out_us": None}, []
        new = {"attempt": attempt, "mode": "approach", "began_us": at, "in_us": None, "out_us": None}
        return new, [(attempt, "action_prompt", None)]

    def _again(self, state, at, reason):
        new, out = self._begin(state["attempt"] + 1, at)
        return new, [(state["attempt"], "invalid", reason), *out]

    def due(self, state):
        limit = {"approach": self.reach_us, "hold": self.hold_us}.get(state["mode"])
        return None if limit is None else state["began_us"] + limit + 1

    def on_time(self, state, at):
        if state["mode"] == "approach":
            return self._again(state, at, "target_not_reached")
        return {**state, "mode": "complete"}, [(state["attempt"], "step_complete", "valid_gated_hold")]

    def on_row(self, state, at, row):
        out = []
        if state["mode"] == "new":
            state, out = self._begin(1, at)
        within = row["value"] is not None and abs(row["value"] - self.target) <= self.tolerance
        if state["mode"] == "approach":
            since = (at if state["in_us"] is None else state["in_us"]) if within else None
            if since is not None and since < at and at - since >= self.stable_us:
                held = {**state, "mode": "hold", "began_us": at, "in_us": None}
                return held, [*out, (state["attempt"], "gated_hold_start", "target_stable")]
            return {**state, "in_us": since}, out
        if state["mode"] == "hold":
            since = None if within else at if state["out_us"] is None else state["out_us"]
            if since is not None and at - since > self.gap_us:
                state, more = self._again(state, at, "gate_lost_during_hold")
                return state, out + more
            return {**state, "out_us": since}, out
        return state, out


@dataclass(frozen=True)
class PairWatch(TimedMachine):
    """Why camera frames with their latest thermal sample are rejected; counters are remembered across pairs.

    Rows are candidate pairs at the camera's time, those of one camera frame in order of thermal_us, which is
    null where no sample was near; the last candidate is the pair. Times are microseconds.
    """

    max_age_us: int
    max_skew_us: int
    _pair = (
        "color_frame long, depth_frame long, color_domain string, depth_domain string, now_us long, thermal_us long, frame_counter long, "
        "packet_ms long, ffc_desired boolean, ffc_in_progress boolean, ffc_state string, tlinear_enabled boolean, tlinear_resolution_k double"
    )
    _counters = ("color_frame", "depth_frame", "frame_counter", "packet_ms")
    state = f"camera_us long, {_pair}, " + ", ".join(f"last_{c} long" for c in _counters)
    output = "color_frame long, frame_counter long, reasons array<string>"

    def initial(self):
        return dict.fromkeys(x.split()[0] for x in self.state.split(", "))

    def due(self, state):
        return None if state["camera_us"] is None else state["camera_us"] + 1

    def on_time(self, state, at):
        judge = PairFreshness(self.max_age_us, self.max_skew_us)
        row = {**state, "now_s": state["now_us"], "camera_s": state["camera_us"], "thermal_s": state["thermal_us"]}
        highest, (reasons,) = judge.step({c: state[f"last_{c}"] for c in self._counters}, row)
        kept = {f"last_{c}": highest[c] for c in self._counters}
        return {**self.initial(), **kept}, [(state["color_frame"], state["frame_counter"], reasons)]

    def on_row(self, state, at, row):
        pair = {x.split()[0]: row[x.split()[0]] for x in self._pair.split(", ")}
        return {**state, "camera_us": at, **pair}, []


@dataclass(frozen=True)
class FrameAssembly(TimedMachine):
    """Frames of four datagrams in a row numbered 1, 2, 3, 4 in one packet mode, with their payload.

    Rows have segment and packets (null when malformed), seq and payload. Anything else between them breaks
    the frame; the open part of a frame is the state.
    """

    state = "expected long, packets long, first_seq long, body binary"
    output = "first_seq long, last_seq long, packets long, payload binary"

    def initial(self):
        return {"expected": 1, "packets": None, "first_seq": None, "body": None}

    def on_row(self, state, at, row):
        segment, packets, payload = row["segment"], row["packets"], bytes(row["payload"] or b"")
        if segment == 1:
            return {"expected": 2, "packets": packets, "first_seq": row["seq"], "body": payload}, []
        if segment is None or segment != state["expected"] or packets != state["packets"]:
            return self.initial(), []
        body = bytes(state["body"]) + payload
        if segment < 4:
            return {**state, "expected": segment + 1, "body": body}, []
        return self.initial(), [(state["first_seq"], row["seq"], packets, body)]


@dataclass(frozen=True)
class PressureWatch(TimedMachine):
    """The pressure estimator over a stream in event-time order, with typed state; rows as it takes them."""

    estimator: PressureEstimator
    state = "thermal_s double, content string, repeats long, baseline array<double>, roi array<long>, active boolean"
    output = "status string, pressure double, active boolean, available boolean, reading_quality double"

    def initial(self):
        return dict.fromkeys(x.split()[0] for x in self.state.split(", "))

    def on_row(self, state, at, row):
        known = {k: v for k, v in state.items() if v is not None}
        new, out = self.estimator.step(known, row)
        return {**self.initial(), **new}, [out]


@dataclass(frozen=True)
class TrackWatch(TimedMachine):
    """A trial's mask tracker: the last accepted shift and hand area are its state.

    Rows are frames as ``hands_beside_anchors`` gives them.
    """

    state = "shift_u long, shift_v long, area long"
    output = "frame long, shift_u int, shift_v int, center_step_px double, area_change_ratio double, tracking_reason string"

    def initial(self):
        return {"shift_u": None, "shift_v": None, "area": None}

    def on_row(self, state, at, row):
        anchor = {k: row[f"anchor_{k}"] for k in ("positions", "distal", "proximal", "finger_width_px")}
        before = (0, 0, len(anchor["positions"])) if state["area"] is None else (state["shift_u"], state["shift_v"], state["area"])
        (u, v, area), shift, step, change, reason = advance(anchor, before, row["positions"], row["width"], row["height"])
        new = {"shift_u": int(u), "shift_v": int(v), "area": int(area)}
        return new, [(row["frame"], int(shift[0]), int(shift[1]), step, change, reason)]
