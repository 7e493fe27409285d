"""User code in a child process of the Python worker, so that it can neither end nor stop the job."""

from __future__ import annotations

import os
import pickle
import select
import struct
import subprocess
import sys
import time

from pyspark import cloudpickle

# What the child runs: requests (number of the function, arguments, seconds) come in and replies go out as length-prefixed
# pickles; whatever user code prints goes to standard error. An alarm ends a child whose worker is gone.
_CHILD = """
import json, os, pickle, signal, struct, sys
source, sink = os.fdopen(os.dup(0), "rb"), os.fdopen(os.dup(1), "wb")
os.dup2(2, 1)
def frame():
    head = source.read(8)
    return source.read(struct.unpack("<Q", head)[0]) if len(head) == 8 else None
sys.path[:], code = pickle.loads(frame())
functions = pickle.loads(code)
def answer(reply):
    data = pickle.dumps(reply)
    sink.write(struct.pack("<Q", len(data)) + data)
    sink.flush()
answer("ready")
while (request := frame()) is not None:
    number, arguments, seconds = pickle.loads(request)
    signal.setitimer(signal.ITIMER_REAL, seconds + 10)
    try:
        out = functions[number](*arguments)
        reply = (out if isinstance(out, str) else json.dumps(out), None)
    except BaseException as e:
        reply = (None, str(e) or type(e).__name__)
    signal.setitimer(signal.ITIMER_REAL, 0)
    answer(reply)
"""
# Seconds that a child may take to load the functions.
START_LIMIT = 60.0


def packed(functions: list) -> bytes:
    """The functions for `Guard`, pickled by value where they are not importable; on the driver."""
    return cloudpickle.dumps(functions)


class Guard:
    """Calls packed functions in a child process; a child that dies or takes too long is replaced for the next call."""

    def __init__(self, code: bytes):
        self._code, self._child = code, None

    def __enter__(self) -> "Guard":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self._child is not None:
            self._child.kill()
            self._child.wait()
            for pipe in (self._child.stdin, self._child.stdout):
                try:
                    pipe.close()
                except OSError:  # what was left to send has no reader
                    pass
            self._child = None

    def _send(self, message) -> None:
        data = pickle.dumps(message)
        self._child.stdin.write(struct.pack("<Q", len(data)) + data)
        self._child.stdin.flush()

    def _receive(self, size: int, until: float) -> bytes:
        out = bytearray()
        pipe = self._child.stdout.fileno()
        while len(out) < size:
            if not select.select([pipe], [], [], max(0.0, until - time.monotonic()))[0]:
                raise TimeoutError
            part = os.read(pipe, min(size - len(out), 1 << 20))
            if not part:
                raise EOFError
            out += part
        return bytes(out)

    def _reply(self, seconds: float):
        until = time.monotonic() + seconds
        size, = struct.unpack("<Q", self._receive(8, until))
        return pickle.loads(self._receive(size, until + seconds))

    def call(self, number: int, arguments: tuple, seconds: float) -> tuple[str | None, str | None]:
        """Output text of a function, or what went wrong."""
        try:
            if self._child is None:
                self._child = subprocess.Popen([sys.executable, "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
                self._send((list(sys.path), self._code))
                self._reply(START_LIMIT)
            self._send((number, arguments, seconds))
            return self._reply(seconds)
        except TimeoutError:
            self.close()
            return None, f"no result within {seconds:g} s"
        except (EOFError, OSError):
            code = self._child.wait() if self._child is not None else None
            self.close()
            return None, f"the analyzer's process ended with code {code}"


# Executors get this module with the analyzers; they need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
