"""What the operators need to know about a trace: column roles and run settings."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TraceSpec:
    name: str
    key: str
    submit: str
    start: str
    end: str
    state: str
    success: str
    run_time: str
    features: tuple[str, ...]
    target: str
    request: str | None
    clusters: int
    first_window: str
    last_window: str
    window_days: int
    window_step: str
    failure: str | None = None
    biases: tuple[str, ...] = ("none", "mean", "mad", "std_dev", "two_sigma")

    def with_(self, **changes) -> TraceSpec:
        return replace(self, **changes)


# Columns, states and window settings of the three public traces.
FUGAKU = TraceSpec(
    name="fugaku", key="jid", submit="adt", start="sdt", end="edt",
    state="exit state", success="completed", failure="failed", run_time="run_time",
    features=("usr", "jnam", "jid", "cnumr", "nnumr", "elpl", "mszl", "freq_req"),
    target="duration", request="elpl", clusters=4,
    first_window="2024-04-05", last_window="2024-04-30", window_days=3, window_step="3D",
)
M100 = TraceSpec(
    name="m100", key="job_id", submit="submit_time", start="start_time", end="end_time",
    state="job_state", success="COMPLETED", run_time="execution_time",
    features=("group_id", "partition", "priority", "user_id", "time_limit_sec"),
    target="execution_time", request="time_limit_sec", clusters=6,
    first_window="2021-12-01", last_window="2021-12-31", window_days=3, window_step="3D",
)
EAGLE = TraceSpec(
    name="eagle", key="job_id", submit="submit_time", start="start_time", end="end_time",
    state="state", success="COMPLETED", failure="TIMEOUT", run_time="run_time",
    features=("wallclock_req", "processors_req", "mem_req", "nodes_req", "gpus_req",
              "user", "partition", "name", "account"),
    target="run_time", request="wallclock_req", clusters=18,
    first_window="2018-11-14", last_window="2023-02-01", window_days=90, window_step="1M",
)
