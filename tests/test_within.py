"""Calls with a deadline."""

import threading
import time

import pytest

from paperloom.sources.recognize import within


def test_calls_share_a_thread_until_one_is_late():
    first = within(5, threading.get_native_id)
    assert first != threading.get_native_id() and all(within(5, threading.get_native_id) == first for _ in range(50))
    with pytest.raises(ValueError):
        within(5, int, "x")
    with pytest.raises(TimeoutError):
        within(0.05, time.sleep, 0.5)
    assert within(5, lambda: 7) == 7  # not the late call's answer
