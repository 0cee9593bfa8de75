"""The alert state machine: debounce on both sides, hysteresis by the condition's own bounds.

A state is (phase, since, onset). INACTIVE -> PENDING -> FIRING -> RESOLVING -> INACTIVE; a debounce of exactly the required
length is enough. A condition that comes back while RESOLVING is the same fault: it fires on, silently, with its onset.
"""

from __future__ import annotations

from typing import NamedTuple

from skytally.rules.model import Alert, Observation, Rule

INACTIVE, PENDING, FIRING, RESOLVING = "INACTIVE", "PENDING", "FIRING", "RESOLVING"


class State(NamedTuple):
    phase: str
    since: int
    onset: int

    @property
    def open(self) -> bool:
        return self.phase in (FIRING, RESOLVING)


def step(rule: Rule, state: State | None, o: Observation) -> tuple[State, Alert | None]:
    """The next state, and the alert that this step opens or closes. Without a state the device is INACTIVE."""
    now = o.at
    phase, since, onset = state or State(INACTIVE, now, now)
    if rule.condition.holds(o, phase in (FIRING, RESOLVING)):
        if phase == FIRING:
            return State(phase, since, onset), None
        if phase == RESOLVING:
            return State(FIRING, now, onset), None
        start = now if phase == INACTIVE else onset
        if now - start >= rule.for_ns:
            return State(FIRING, now, start), _alert(rule, o, "FIRED", start, rule.for_ns)
        return State(PENDING, now if phase == INACTIVE else since, start), None
    if phase == INACTIVE:
        return State(phase, since, onset), None
    if phase == PENDING:
        return State(INACTIVE, now, now), None
    cleared = now if phase == FIRING else since
    if now - cleared >= rule.clear_ns:
        return State(INACTIVE, now, now), _alert(rule, o, "RESOLVED", cleared, rule.clear_ns)
    return State(RESOLVING, cleared, onset), None


def _alert(rule: Rule, o: Observation, kind: str, start: int, debounce: int) -> Alert:
    return Alert(rule.id, rule.name, o.tenant_id, o.device_id, rule.severity, kind, start, o.at, debounce, rule.condition.describe(o))


def observe(rules: list[Rule], states: dict[str, State], o: Observation) -> list[Alert]:
    """Steps every rule that applies; changed states are written back, unchanged ones are not."""
    alerts = []
    for rule in rules:
        if rule.applies_to(o.tenant_id, o.device_id):
            key = rule.key(o.device_id)
            before = states.get(key) or State(INACTIVE, o.at, o.at)
            after, alert = step(rule, before, o)
            if after != before:
                states[key] = after
            if alert:
                alerts.append(alert)
    return alerts
