"""Requests to models from Spark's workers: many at once, in order, each with its own failure; and one budget for all workers."""

from __future__ import annotations

import hashlib
import json
import socket
import socketserver
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field

from pyspark import cloudpickle

#: What factories have made in this Python process, by the digest of the factory.
_MADE: dict[str, object] = {}
_LOCK = threading.Lock()


def factory_key(make: Callable) -> str:
    """A name for a factory, the same in all tasks that are sent it. To be made on the driver."""
    return hashlib.sha256(cloudpickle.dumps(make)).hexdigest()


def of_process(key: str, make: Callable[[], object]) -> object:
    """What make() returns, once in each Python process: a limiter or client that goes on over batches and tasks."""
    with _LOCK:
        if key not in _MADE:
            _MADE[key] = make()
        return _MADE[key]


@dataclass
class Answer:
    """What a request gave: a value or an error."""

    value: object = None
    error: Exception | None = None


def ask_many(items: Iterable, ask: Callable[[object], object], at_once: int = 1) -> Iterator[Answer]:
    """Answers to items, in their order, with at most at_once requests under way and as many answers waiting: items are taken as answers are given away. A request that fails is an Answer with its error; the others go on."""

    def one(item: object) -> Answer:
        try:
            return Answer(ask(item))
        except Exception as failed:
            return Answer(error=failed)

    if at_once <= 1:
        yield from map(one, items)
        return
    waiting: deque = deque()
    with ThreadPoolExecutor(at_once) as pool:
        try:
            for item in items:
                waiting.append(pool.submit(one, item))
                if len(waiting) >= 2 * at_once:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()
        finally:
            for w in waiting:
                w.cancel()


def slot_of(limiter, tokens: int):
    return limiter.slot(tokens) if limiter is not None else nullcontext()


# one budget for all workers


@dataclass
class _Lease:
    name: int
    requests: int
    tokens: int
    until: float  # when it counts no more


@dataclass
class Book:
    """What is given out of a budget of requests and tokens in a window. A lease may be used for `lease_seconds`, and counts for a window after that, so that no window of the workers' calls holds more than the budget. What is given
    back unused counts no more. Requests under way are held by their owners; an owner that is gone holds none, but what it has leased stays counted, as nobody knows whether it was used."""

    rpm: int
    tpm: int
    window_seconds: float = 60.0
    lease_seconds: float = 5.0
    max_concurrent: int = 1_000_000
    clock: Callable[[], float] = time.monotonic
    leases: list[_Lease] = field(default_factory=list)
    running: dict[int, int] = field(default_factory=dict)
    given: int = 0

    def take(self, requests: int, tokens: int) -> dict:
        """A lease of at most so many requests and tokens, at least one request and `tokens` tokens; or how long to wait. A call above the whole budget goes alone."""
        now = self.clock()
        self.leases = [x for x in self.leases if x.until > now]
        free, left = self.rpm - sum(x.requests for x in self.leases), self.tpm - sum(x.tokens for x in self.leases)
        if free < 1 or (tokens > left and self.leases):
            return {"wait": max(min(x.until for x in self.leases) - now, 1e-3)}
        self.given += 1
        lease = _Lease(self.given, min(requests, free), max(tokens, min(left, requests * tokens)), now + self.lease_seconds + self.window_seconds)
        self.leases.append(lease)
        return {"requests": lease.requests, "tokens": lease.tokens, "seconds": self.lease_seconds, "lease": lease.name}

    def give_back(self, lease: int, requests: int, tokens: int) -> dict:
        for x in self.leases:
            if x.name == lease:
                x.requests -= requests
                x.tokens -= tokens
        self.leases = [x for x in self.leases if x.requests > 0 or x.tokens > 0]
        return {}

    def enter(self, owner: int) -> dict:
        if sum(self.running.values()) >= self.max_concurrent:
            return {"wait": 0.02}
        self.running[owner] = self.running.get(owner, 0) + 1
        return {}

    def leave(self, owner: int) -> dict:
        self.running[owner] -= 1
        return {}

    def gone(self, owner: int) -> None:
        self.running.pop(owner, None)


class BudgetServer:
    """Hands out leases of one Book to the limiters of all workers, over a socket of the driver. `limiter()` makes what a worker is given; close() ends the service."""

    def __init__(self, book: Book, host: str = "127.0.0.1") -> None:
        secret, lock, self.book = uuid.uuid4().hex, threading.Lock(), book

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                owner = id(self)
                if json.loads(self.rfile.readline() or b"null") != secret:
                    return
                try:
                    for line in self.rfile:
                        what, *args = json.loads(line)
                        with lock:
                            answer = getattr(book, what)(*args) if what in ("take", "give_back") else getattr(book, what)(owner)
                        self.wfile.write(json.dumps(answer).encode() + b"\n")
                except OSError:
                    pass
                finally:  # also when the worker is killed: its socket is closed
                    with lock:
                        book.gone(owner)

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads, allow_reuse_address = True, True

        self.server = Server((host, 0), Handler)
        self.address, self.secret = (host, self.server.server_address[1]), secret
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def limiter(self, lease_requests: int = 8) -> Callable[[], SharedLimiter]:
        address, secret = self.address, self.secret
        return lambda: SharedLimiter(address, secret, lease_requests)

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


class SharedLimiter:
    """A worker's side of a BudgetServer: slot() waits for a part of a lease and for a place among the requests under way. What is left of a lease is given back when no thread of this process uses the limiter any more."""

    def __init__(self, address: tuple[str, int], secret: str, lease_requests: int = 8, sleep: Callable[[float], None] = time.sleep) -> None:
        self.address, self.secret, self.lease_requests, self.sleep = address, secret, lease_requests, sleep
        self.lock, self.users, self.held, self.until = threading.Lock(), 0, None, 0.0
        self.stream = None

    def _say(self, *what) -> dict:
        if self.stream is None:
            self.stream = socket.create_connection(self.address).makefile("rwb")
            self.stream.write(json.dumps(self.secret).encode() + b"\n")
        self.stream.write(json.dumps(what).encode() + b"\n")
        self.stream.flush()
        line = self.stream.readline()
        if not line:
            raise ConnectionError("the budget's service is gone")
        return json.loads(line)

    def _return(self) -> None:
        if self.held and (self.held["requests"] > 0 or self.held["tokens"] > 0):
            self._say("give_back", self.held["lease"], self.held["requests"], self.held["tokens"])
        self.held = None

    def _part(self, tokens: int) -> float:
        """Takes a request and tokens of the lease, or a new one; else how long to wait."""
        fits = self.held and self.held["requests"] > 0 and self.held["tokens"] >= tokens and time.monotonic() < self.until
        if not fits:
            self._return()
            asked = time.monotonic()
            told = self._say("take", self.lease_requests, tokens)
            if "wait" in told:
                return told["wait"]
            self.held, self.until = told, asked + told["seconds"]
        self.held["requests"] -= 1
        self.held["tokens"] -= tokens
        return 0.0

    @contextmanager
    def slot(self, tokens: int) -> Iterator[None]:
        with self.lock:
            self.users += 1
        entered = False
        try:
            while True:  # first a place, so that what is leased is used at once
                with self.lock:
                    wait = self._say("enter").get("wait", 0.0)
                if not wait:
                    break
                self.sleep(wait)
            entered = True
            while True:
                with self.lock:
                    wait = self._part(tokens)
                if not wait:
                    break
                self.sleep(wait)
            yield
        finally:
            with self.lock:
                if entered:
                    self._say("leave")
                self.users -= 1
                if not self.users:
                    self._return()
