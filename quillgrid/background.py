"""Durable jobs: a command runs in a process of its own, with its state in a file and its output in a log.

A job survives the end of the caller; what state it is in follows from the file, from whether its worker still lives and
from the checks of its output, so a worker that was killed shows as interrupted and can be resumed.
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import time
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from quillgrid.operators.jobs import ACTIVE, CONTRACT

STATE, LOG, PROGRESS, VERDICT = "job.json", "job.log", "progress.json", "verdict.json"
FINAL = ("completed", "failed", "interrupted")
#: Bytes of the log that its tail is taken from.
TAIL_BYTES = 64 << 10


def now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _read(path: Path, default=None):
    """A JSON file, or ``default`` where there is none."""
    try:
        return json.loads(path.read_text("utf-8"))
    except FileNotFoundError:
        return default


def _write(path: Path, value) -> None:
    """Put a JSON file in place as a whole, so that no reader sees half of it."""
    part = path.with_name(f"{path.name}.{os.getpid()}.part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=1), "utf-8")
    os.replace(part, path)


def _lives(pid: int | None) -> bool:
    if not pid:
        return False
    try:
        if os.waitpid(pid, os.WNOHANG)[0] == pid:  # a worker of this process that has ended
            return False
    except ChildProcessError:
        pass
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


def log_tail(work: str | Path, lines: int = 12) -> list[str]:
    """The last lines of a job's log; however long the log is, only its end is read."""
    try:
        with open(Path(work) / LOG, "rb") as f:
            f.seek(max(0, f.seek(0, os.SEEK_END) - TAIL_BYTES))
            return f.read().decode("utf-8", "replace").splitlines()[-lines:]
    except FileNotFoundError:
        return []


def status(work: str | Path) -> dict:
    """Settled state of a job with its progress and the end of its log; ``not-found`` without one."""
    work = Path(work)
    job = _read(work / STATE)
    if job is None:
        return {"status": "not-found", "progress": {}, "log": []}
    verdict = _read(work / VERDICT, {})
    passed = bool(verdict.get("passed")) and verdict.get("contract_version", 0) >= CONTRACT and verdict.get("run") == job["run"]
    state = "completed" if passed else job["status"]
    if state in ACTIVE and not _lives(job.get("worker")):
        state = "interrupted"
    return {**job, "status": state, "passed": passed, "progress": _read(work / PROGRESS, {}), "log": log_tail(work)}


def _launch(work: Path, job: dict) -> dict:
    """Start a worker that takes the job over; it waits until its number is in the file."""
    _write(work / STATE, job)
    worker = subprocess.Popen([sys.executable, "-m", "quillgrid.background", "worker", str(work)], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True, cwd=Path(__file__).resolve().parents[1])
    _write(work / STATE, job | {"worker": worker.pid})
    return status(work)


def start(work: str | Path, inputs: str, command: list[str]) -> dict:
    """Start a job unless one with the same input runs or has completed; ``launch`` says which."""
    work = Path(work)
    work.mkdir(parents=True, exist_ok=True)
    seen = status(work)
    if seen.get("input") == inputs and (seen["status"] in ACTIVE or seen["status"] == "completed" and seen["passed"]):
        return seen | {"launch": "already-completed" if seen["status"] == "completed" else "already-running"}
    job = {"status": "starting", "input": inputs, "command": command, "run": 1 + seen.get("run", 0), "started": now(), "ended": None, "worker": None, "exit": None}
    return _launch(work, job) | {"launch": "started"}


def resume(work: str | Path) -> dict:
    """Run the command of an interrupted or failed job again."""
    work = Path(work)
    seen = status(work)
    if seen["status"] == "not-found":
        raise FileNotFoundError(f"no job in {work}")
    if seen["status"] in ACTIVE or seen["status"] == "completed":
        return seen | {"launch": "already-completed" if seen["status"] == "completed" else "already-running"}
    job = _read(work / STATE) | {"status": "starting", "run": seen["run"] + 1, "started": now(), "ended": None, "worker": None, "exit": None}
    return _launch(work, job) | {"launch": "resumed"}


def wait(work: str | Path, tell: Callable[[dict], None] | None = None, every: float = 15.0) -> dict:
    """Wait until a job has ended; ``tell`` hears of it only when its state or progress has changed."""
    told = None
    while True:
        seen = status(work)
        if seen["status"] == "not-found":
            raise FileNotFoundError(f"no job in {work}")
        if (mark := (seen["status"], seen["progress"])) != told:
            told = mark
            if tell:
                tell(seen)
        if seen["status"] in FINAL:
            return seen
        time.sleep(every)


def work_on(work: str | Path) -> int:
    """The worker: run the command with its output in the log and note how it ended."""
    work = Path(work)
    for _ in range(250):
        if (job := _read(work / STATE, {})).get("worker") == os.getpid():
            break
        time.sleep(0.02)
    with open(work / LOG, "a", encoding="utf-8") as log:
        log.write(f"{now()} run {job['run']} begins\n")
        log.flush()
        _write(work / STATE, job | {"status": "running"})
        try:
            code = subprocess.run(job["command"], stdin=subprocess.DEVNULL, stdout=log, stderr=subprocess.STDOUT, env=os.environ | {"QUILLGRID_RUN": str(job["run"])}).returncode
        except OSError as e:
            log.write(f"{type(e).__name__}: {e}\n")
            code = 127
        log.write(f"{now()} run {job['run']} ends with {code}\n")
    _write(work / STATE, job | {"status": "failed" if code else "completed", "exit": code, "ended": now()})
    return code


def note_progress(work: str | Path, counts: dict) -> None:
    """Called by a command: how far it is."""
    Path(work).mkdir(parents=True, exist_ok=True)
    _write(Path(work) / PROGRESS, counts)


def note_verdict(work: str | Path, passed: bool) -> None:
    """Called by a command when its output has been checked."""
    Path(work).mkdir(parents=True, exist_ok=True)
    _write(Path(work) / VERDICT, {"passed": passed, "contract_version": CONTRACT, "run": int(os.environ.get("QUILLGRID_RUN", "0"))})


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="python -m quillgrid.background")
    p.add_argument("action", choices=["start", "resume", "status", "wait", "worker"])
    p.add_argument("work")
    p.add_argument("--input", default="")
    p.add_argument("--every", type=float, default=15.0)
    p.add_argument("command", nargs="*", help="after --: the command of a job to start")
    a = p.parse_args(args)
    show = lambda seen: print(json.dumps(seen, ensure_ascii=False), flush=True)
    if a.action == "worker":
        return work_on(a.work)
    if a.action == "wait":
        return int(wait(a.work, show, a.every)["status"] != "completed")
    seen = {"start": lambda: start(a.work, a.input, a.command), "resume": lambda: resume(a.work), "status": lambda: status(a.work)}[a.action]()
    show(seen)
    return 2 if seen["status"] == "not-found" else 0


if __name__ == "__main__":
    sys.exit(main())
