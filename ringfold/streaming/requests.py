"""Non-blocking operations: a lazy DataFrame whose action runs in a thread and a job group of its own."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame

_threads = ThreadPoolExecutor(16, thread_name_prefix="request")


class Request:
    """A running operation; a null request has none and is complete at once."""

    def __init__(self, future: Future | None = None, cancel: Callable[[], None] | None = None):
        self._future, self._cancel = future, cancel

    def is_null(self) -> bool:
        return self._future is None

    def test(self) -> bool:
        return self._future is None or self._future.done()

    def wait(self, timeout: float | None = None):
        return None if self._future is None else self._future.result(timeout)

    def cancel(self) -> None:
        if self._cancel:
            self._cancel()


class NonBlockingResult:
    """Gives its result out once: by wait, or by test when it is done."""

    def __init__(self, request: Request):
        self.request, self._taken = request, False

    def wait(self, timeout: float | None = None):
        found = self.request.wait(timeout)
        return self._take(found)

    def test(self):
        """None while running."""
        return self._take(self.request.wait()) if self.request.test() else None

    @property
    def done(self) -> bool:
        """Also tells a finished operation without a result from a running one."""
        return self.request.test()

    def extract(self) -> Request:
        """Hands over the request; nothing is left here."""
        self._taken, request, self.request = True, self.request, Request()
        return request

    def _take(self, found):
        if self._taken:
            raise RuntimeError("the result was taken before")
        self._taken = True
        return found


def start(df: DataFrame, action: Callable[[DataFrame], object] | None = None) -> NonBlockingResult:
    """Starts an action on df (by default: compute it and cache the result) and returns at once."""
    return _submit(df.sparkSession.sparkContext, lambda: action(df) if action else _computed(df))


def _computed(found):
    """A table is computed and cached; whatever else an operation gives is there already."""
    if isinstance(found, DataFrame):
        found = found.persist()
        found.count()
    return found


def _submit(sc, call: Callable[[], object]) -> NonBlockingResult:
    group = f"request-{uuid.uuid4().hex}"

    def run():
        sc.setJobGroup(group, "non-blocking operation", interruptOnCancel=True)
        return call()

    return NonBlockingResult(Request(_threads.submit(run), lambda: sc.cancelJobGroup(group)))


def wait_all(requests: list[Request]) -> list:
    return [r.wait() for r in requests]


class RequestPool:
    def __init__(self):
        self.requests: list[Request] = []

    def add(self, result: NonBlockingResult | Request) -> int:
        """Adds a running operation; its index."""
        self.requests.append(result.request if isinstance(result, NonBlockingResult) else result)
        return len(self.requests) - 1

    @property
    def num_requests(self) -> int:
        return len(self.requests)

    @property
    def index_end(self) -> int:
        return len(self.requests)

    def wait_all(self) -> list:
        return wait_all(self.requests)

    def test_all(self) -> bool:
        return all(r.test() for r in self.requests)

    def _active(self) -> dict[Future, int]:
        return {r._future: k for k, r in enumerate(self.requests) if not r.is_null()}

    def wait_any(self) -> int:
        """The index of one that is complete, which is null from then on; index_end if none is active."""
        if not (active := self._active()):
            return self.index_end
        done, _ = wait(active, return_when=FIRST_COMPLETED)
        return self._finish(min(active[f] for f in done))

    def test_any(self) -> int | None:
        """As wait_any, but None if none is complete."""
        if not (active := self._active()):
            return self.index_end
        done = [k for f, k in active.items() if f.done()]
        return self._finish(min(done)) if done else None

    def _finish(self, k: int) -> int:
        self.requests[k].wait()
        self.requests[k] = Request()
        return k


class NonBlocking:
    """The non-blocking forms of a communicator's operations."""

    def __init__(self, comm):
        self.comm = comm

    def __getattr__(self, name: str):
        if not name.startswith("i") or not hasattr(self.comm, name[1:]):
            raise AttributeError(name)
        blocking = getattr(self.comm, name[1:])
        # The call itself runs in the thread too, as some operations compute something before they return.
        return lambda *a, **k: _submit(self.comm.spark.sparkContext, lambda: _computed(blocking(*a, **k)))
