"""Per-stream state machines: a few values of state, one step per sample.

Everything that does not depend on earlier samples (contrast, blob region,
quality, content hash, region mean) is computed as columns before a machine
sees the row. A machine keeps its state in a plain dict.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import hypot
from statistics import median

from pyspark.sql import types as T

_D, _B, _S, _L = T.DoubleType(), T.BooleanType(), T.StringType(), T.LongType()


def late(later: float, earlier: float, limit: float) -> bool:
    """``later - earlier`` beyond the limit, with one unit of rounding tolerance."""
    return later - earlier > limit + max(abs(later), abs(earlier), limit) * 2.0**-52


class Machine:
    """``output`` lists the added columns; ``step`` returns the new state and their values."""

    output: tuple[tuple[str, T.DataType], ...] = ()

    def initial(self) -> dict:
        return {}

    def step(self, state: dict, row: dict) -> tuple[dict, tuple]:
        raise NotImplementedError


@dataclass(frozen=True)
class StableGate(Machine):
    """Open once the value has stayed in tolerance for ``required_s``."""

    target: float
    tolerance: float
    required_s: float
    at: str = "t"
    value: str = "value"
    output = (("stable_s", _D), ("gate_open", _B))

    def step(self, state, row):
        value, now = row[self.value], row[self.at]
        if value is None or abs(value - self.target) > self.tolerance:
            return {}, (0.0, False)
        if "since" not in state:
            return {"since": now}, (0.0, False)
        held = max(0.0, now - state["since"])
        return state, (held, held >= self.required_s)


@dataclass(frozen=True)
class HoldGate(Machine):
    """True in tolerance and through outliers of up to ``max_gap_s``."""

    target: float
    tolerance: float
    max_gap_s: float
    at: str = "t"
    value: str = "value"
    output = (("hold_ok", _B),)

    def step(self, state, row):
        value, now = row[self.value], row[self.at]
        if value is not None and abs(value - self.target) <= self.tolerance:
            return {}, (True,)
        since = state.get("out", now)
        return {"out": since}, (now - since <= self.max_gap_s,)


@dataclass(frozen=True)
class CycleCounter(Machine):
    """Complete open, closed, open cycles with hysteresis."""

    close: float = 0.045
    reopen: float = 0.055
    value: str = "value"
    output = (("cycles", _L),)

    def initial(self):
        return {"wait": "open", "cycles": 0}

    def step(self, state, row):
        value, wait, cycles = row[self.value], state["wait"], state["cycles"]
        if wait == "close":
            wait = "reopen" if value <= self.close else wait
        elif value >= self.reopen:
            cycles += wait == "reopen"
            wait = "close"
        return {"wait": wait, "cycles": cycles}, (cycles,)


@dataclass(frozen=True)
class PressureEstimator(Machine):
    """Ordered sensor checks, contact hysteresis and region baseline of one stream.

    Rows carry now_s, oak_s, thermal_s, readable, shape_ok, frame_range, content,
    roi, roi_mode, quality, crop, blob_delta, pinch and enabled. A fault resets the
    state it names; a repeated timestamp changes nothing.
    """

    near_contact: float = 0.045
    exit_contact: float = 0.055
    baseline_share: float = 0.08
    full_scale: float = 24.0
    min_quality: float = 0.5
    min_range: float = 2.0
    max_repeats: int = 5
    max_oak_age_s: float = 0.20
    max_thermal_age_s: float = 0.20
    max_skew_s: float = 0.15
    blob: bool = False
    output = (("status", _S), ("pressure", _D), ("active", _B), ("available", _B), ("reading_quality", _D))

    def step(self, state, row):
        now, oak, thermal = row["now_s"], row["oak_s"], row["thermal_s"]
        fault = lambda s, name: (s, (name, 0.0, False, False, 0.0))
        # Contact, baseline and repeats go; the last accepted timestamp stays.
        cleared = {k: v for k, v in state.items() if k == "thermal_s"}
        if not row["readable"]:
            return fault(cleared, "thermal_unavailable")
        if oak is None or now - oak < 0 or late(now, oak, self.max_oak_age_s):
            return fault(cleared, "oak_stale")
        if thermal is None or now - thermal < 0 or late(now, thermal, self.max_thermal_age_s):
            return fault(cleared, "thermal_stale")
        last = state.get("thermal_s")
        if last is not None and thermal < last:
            return fault(cleared, "thermal_stale")
        if last is not None and thermal == last:
            return state, ("thermal_pending", 0.0, False, True, 0.0)
        if late(max(oak, thermal), min(oak, thermal), self.max_skew_s):
            return fault(cleared, "sensor_skew")
        if not row["shape_ok"]:
            return fault(cleared, "thermal_shape_mismatch")
        if row["frame_range"] is None:
            return fault(cleared, "thermal_unavailable")
        if row["frame_range"] < self.min_range:
            return fault(cleared, "thermal_low_contrast")
        repeats = state.get("repeats", 0) + 1 if state.get("content") == row["content"] else 0
        seen = {"thermal_s": thermal, "content": row["content"], "repeats": repeats}
        if repeats > self.max_repeats:
            return fault(seen, "thermal_stale")
        if row["roi"] is None:
            return fault(seen, row["roi_mode"])
        quality = row["quality"]
        if quality < self.min_quality:
            return seen, ("low_quality", 0.0, False, False, quality)
        if not row["enabled"]:
            return {"thermal_s": thermal}, ("disabled", 0.0, False, True, quality)
        kept = {k: state[k] for k in ("baseline", "roi") if k in state}
        active = state.get("active", False)
        if not active and row["pinch"] <= self.near_contact:
            active = True
        elif active and row["pinch"] >= self.exit_contact:
            active = False
        roi = list(row["roi"])
        fits = kept.get("roi") == roi and len(kept.get("baseline", ())) == len(row["crop"] or ())
        new = {**seen, **kept, "active": active}
        if not active:
            if not self.blob:
                crop = [float(v) for v in row["crop"]]
                if fits:
                    a = self.baseline_share
                    crop = [a * c + (1.0 - a) * b for c, b in zip(crop, kept["baseline"])]
                new |= {"baseline": crop, "roi": roi}
            return new, ("baseline", 0.0, False, True, quality)
        if self.blob:
            pressure = max(row["blob_delta"], 0.0) / self.full_scale
        elif not fits:
            return new, ("active_no_baseline", 0.0, True, False, quality)
        else:
            rises = [max(float(c) - b, 0.0) for c, b in zip(row["crop"], kept["baseline"])]
            pressure = sum(rises) / len(rises) / self.full_scale
        return new, ("active", min(max(pressure, 0.0), 1.0), True, True, quality)


@dataclass(frozen=True)
class QuotaProtocol(Machine):
    """Six groups of touch, press and return, each a quota of accepted samples.

    Rows are events: ``unlock``, ``space`` or ``sample`` (with centre u, v), at
    time t. A recording phase over its time limit invalidates the group.
    """

    groups: int = 6
    quota: int = 5
    timeout_s: float = 10.0
    stop_on_timeout: bool = False
    output = (
        ("phase", _S), ("group_index", _L), ("quota_accepted", _B), ("valid_samples", _L),
        ("center_shift_px", _D), ("group_completed", _B),
    )

    def initial(self):
        return {"phase": "warmup", "group": None, "n": 0, "centers": [], "base": None, "since": None}

    def _after(self, state, done: bool):
        last = state["group"] + 1 >= self.groups
        phase = "complete" if last else "rest"
        if not done and self.stop_on_timeout:
            phase = "blocked"
        group = state["group"] if phase == "rest" else None
        return {**state, "phase": phase, "group": group, "n": 0, "since": None}

    def step(self, state, row):
        event, now, phase = row["event"], row["t"], state["phase"]
        accepted, shift, completed = False, None, False
        if phase.startswith("record_") and now - state["since"] >= self.timeout_s:
            state = self._after(state, False)
        elif event == "unlock" and phase == "warmup":
            state = {**self.initial(), "phase": "prepare_just_touch", "group": 0}
        elif event == "space" and phase.startswith("prepare_"):
            state = {**state, "phase": phase.replace("prepare_", "record_"), "since": now, "n": 0}
        elif event == "space" and phase == "rest":
            state = {**self.initial(), "phase": "prepare_just_touch", "group": state["group"] + 1}
        elif event == "sample" and phase.startswith("record_"):
            accepted = True
            center = [row["u"], row["v"]]
            if phase == "record_just_touch":
                state = {**state, "centers": [*state["centers"], center]}
            else:
                shift = hypot(center[0] - state["base"][0], center[1] - state["base"][1])
            state = {**state, "n": state["n"] + 1}
            if state["n"] >= self.quota:
                if phase == "record_just_touch":
                    base = [float(median(c[i] for c in state["centers"])) for i in (0, 1)]
                    state = {**state, "phase": "prepare_press_hard", "base": base, "n": 0, "since": None}
                elif phase == "record_press_hard":
                    state = {**state, "phase": "prepare_return_touch", "n": 0, "since": None}
                else:
                    completed = True
                    state = self._after(state, True)
        return state, (state["phase"], state["group"], accepted, state["n"], shift, completed)


@dataclass(frozen=True)
class AttemptLoop(Machine):
    """Approach until the gate opens, hold, retry: the event log of one step.

    Rows are samples (t, value) of a planned step with target and hold_s.
    """

    tolerance: float
    stable_s: float
    max_reach_s: float
    max_gap_s: float
    attempts: int
    output = (("attempt", _L), ("event", _S), ("reason", _S))

    def initial(self):
        return {"attempt": 1, "mode": "approach", "began": None, "gate": {}, "hold": {}}

    def step(self, state, row):
        now, mode = row["t"], state["mode"]
        if mode in ("complete", "failed"):
            return state, (state["attempt"], None, None)
        if state["began"] is None:
            state = {**state, "began": now}
        attempt = state["attempt"]
        again = {**self.initial(), "attempt": attempt + 1, "mode": "approach" if attempt < self.attempts else "failed"}
        if mode == "approach":
            gate = StableGate(row["target"], self.tolerance, self.stable_s)
            held, (_, reached) = gate.step(state["gate"], row)
            if reached:
                hold = {**state, "mode": "hold", "began": now, "hold": {}}
                return hold, (attempt, "gated_hold_start", "target_stable")
            if now - state["began"] > self.max_reach_s:
                return again, (attempt, "invalid", "target_not_reached")
            return {**state, "gate": held}, (attempt, None, None)
        hold = HoldGate(row["target"], self.tolerance, self.max_gap_s)
        kept, (ok,) = hold.step(state["hold"], row)
        if not ok:
            return again, (attempt, "invalid", "gate_lost_during_hold")
        if now - state["began"] >= row["hold_s"]:
            return {**state, "mode": "complete"}, (attempt, "step_complete", "valid_gated_hold")
        return {**state, "hold": kept}, (attempt, None, None)


@dataclass(frozen=True)
class PublicationGate(Machine):
    """Each publication is due once; a stall or read error is reported once per publication.

    Rows are polls with generation, now_s, observed_s, started_s and error.
    """

    max_age_s: float = 0.20
    output = (("due", _B), ("report", _S))

    def initial(self):
        return {"generation": 0, "reported": None}

    def step(self, state, row):
        generation = row["generation"]
        reference = row["observed_s"] if row["observed_s"] is not None else row["started_s"]
        stale = reference is not None and late(row["now_s"], reference, self.max_age_s)
        fault = None
        if row["error"] is not None or (stale and row["observed_s"] is None):
            fault = "thermal_unavailable"
        elif stale:
            fault = "thermal_stale"
        new = generation != state["generation"]
        told = None if new else state["reported"]
        if fault is not None and told != generation:
            return {"generation": generation, "reported": generation}, (new, fault)
        return {"generation": generation, "reported": told}, (new and fault is None, None)


@dataclass(frozen=True)
class SoakMonitor(Machine):
    """Source watchdogs, hand state and fault latch of a soak session.

    Rows are control ticks with now_s, frame_id, observed_s, hand_valid, fist,
    status and available of the pressure reading, pinch. After a terminal reason
    nothing more is judged.
    """

    max_stall_s: float = 0.5
    close: float = 0.045
    reopen: float = 0.055
    output = (
        ("state", _S), ("cycles", _L), ("fault_latched", _B), ("terminal_reason", _S),
    )

    def initial(self):
        return {"start": None, "id": None, "seen": None, "latched": False, "end": None,
                "counter": CycleCounter(self.close, self.reopen).initial()}

    def step(self, state, row):
        cycles = state["counter"]["cycles"]
        if state["end"] is not None:
            return state, (None, cycles, state["latched"], state["end"])
        now, frame_id, observed = row["now_s"], row["frame_id"], row["observed_s"]
        if state["start"] is None:
            state = {**state, "start": now}
        end, fresh = None, False
        if frame_id is None:
            end = "oak_no_first_frame_stall" if late(now, state["start"], self.max_stall_s) else None
            state = {**state, "end": end}
            return state, (None, cycles, state["latched"], end)
        if observed is None:
            end = "oak_observed_timestamp_invalid"
        elif state["id"] is None or frame_id > state["id"]:
            fresh = True
            if state["seen"] is not None and observed < state["seen"]:
                end = "oak_observed_timestamp_regression"
            elif state["seen"] is not None and late(observed, state["seen"], self.max_stall_s):
                end = "oak_observed_timestamp_gap"
            state = {**state, "id": frame_id, "seen": observed}
        if end is None and late(now, state["seen"], self.max_stall_s):
            end = "oak_publication_stall"
        if end is not None:
            return {**state, "end": end}, (None, cycles, state["latched"], end)
        known = row["fist"] in ("open", "closed")
        hand = "HOLD" if not row["hand_valid"] or not known else "MIDDLE" if row["fist"] == "closed" else "MOVING"
        if hand == "MOVING" and fresh:
            counter, (cycles,) = CycleCounter(self.close, self.reopen).step(state["counter"], {"value": row["pinch"]})
            state = {**state, "counter": counter}
        latched = state["latched"]
        if row["status"] is not None and not row["available"]:
            latched = True
        elif row["status"] == "baseline":
            latched = False
        return {**state, "latched": latched}, (hand, cycles, latched, None)


@dataclass(frozen=True)
class PairFreshness(Machine):
    """Why a camera/thermal pair is rejected: ages, skew, domains, counters, shutter, scale."""

    max_age_s: float = 0.20
    max_skew_s: float = 0.15
    output = (("reasons", T.ArrayType(_S)),)

    def step(self, state, row):
        now, camera, thermal = row["now_s"], row["camera_s"], row["thermal_s"]
        reasons = []
        if None in (now, camera, thermal):
            reasons.append("host_read_completion_time_invalid")
        else:
            if not 0.0 <= now - camera <= self.max_age_s:
                reasons.append("d435_host_read_completion_stale")
            if not 0.0 <= now - thermal <= self.max_age_s:
                reasons.append("lepton_host_read_completion_stale")
            if abs(camera - thermal) > self.max_skew_s:
                reasons.append("host_read_completion_skew_exceeded")
        if row["color_domain"] != row["depth_domain"]:
            reasons.append("d435_timestamp_domain_mismatch")
        counters = (
            ("color_frame", "d435_color_frame_non_increasing"),
            ("depth_frame", "d435_depth_frame_non_increasing"),
            ("frame_counter", "lepton_frame_counter_non_increasing"),
            ("packet_ms", "lepton_packet_timestamp_non_increasing"),
        )
        behind = [
            name for field, name in counters
            if row[field] is not None and state.get(field) is not None and row[field] <= state[field]
        ]
        reasons += [r for r in behind if r.startswith("d435")]
        if row["frame_counter"] is None:
            reasons.append("lepton_telemetry_missing")
        else:
            if row["ffc_desired"]:
                reasons.append("lepton_ffc_desired")
            if row["ffc_in_progress"]:
                reasons.append("lepton_ffc_in_progress")
            if row["ffc_state"] != "complete":
                reasons.append("lepton_ffc_not_idle")
            if not row["tlinear_enabled"] or row["tlinear_resolution_k"] != 0.01:
                reasons.append("lepton_tlinear_invalid")
            reasons += [r for r in behind if r.startswith("lepton")]
        highest = dict(state)
        for field, _ in counters:
            if row[field] is not None:
                highest[field] = max(row[field], state.get(field) or row[field])
        return highest, (reasons,)


@dataclass(frozen=True)
class GapCounter(Machine):
    """Missing reads in a row, and whether the stream is given up."""

    limit: int = 15
    flag: str = "missing"
    output = (("gaps_in_row", _L), ("stream_lost", _B))

    def step(self, state, row):
        n = state.get("n", 0) + 1 if row[self.flag] else 0
        lost = state.get("lost", False) or n >= self.limit
        return {"n": n, "lost": lost}, (n, lost)


@dataclass(frozen=True)
class SegmentAssembler(Machine):
    """Completes a frame on segment four of an unbroken 1, 2, 3, 4 of one packet mode.

    Rows carry segment (null when malformed), packets and seq; the output names
    the sequence number of the frame's first segment.
    """

    output = (("frame_start", _L),)

    def step(self, state, row):
        segment, packets = row["segment"], row["packets"]
        if segment is None or not 1 <= segment <= 4:
            return {}, (None,)
        if segment == 1:
            return {"next": 2, "packets": packets, "start": row["seq"]}, (None,)
        if state.get("next") != segment or state.get("packets") != packets:
            return {}, (None,)
        if segment < 4:
            return {**state, "next": segment + 1}, (None,)
        return {}, (state["start"],)
