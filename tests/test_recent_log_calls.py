"""How often the log of recent requests asks for its state."""

import datetime

import pandas as pd

from blockyard.streaming.jobs import SILENCE_MS, RecentLog


class State:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def put(self, value):
        self.calls.append("put")
        self.value = value

    def appendList(self, value):
        self.calls.append("append")
        self.value = (self.value or []) + value

    def clear(self):
        self.calls.append("clear")
        self.value = None


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, name, schema):
        return State(self.calls)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.append(at)


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def rows(*pairs):
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=us) for us, _ in pairs]
    return pd.DataFrame({"tab_id": 1, "request_id": [i for _, i in pairs], "ts": pd.to_datetime(at)})


def test_a_tab_costs_three_calls_at_first_and_then_two():
    handle, log = Handle(), RecentLog(3)
    log.init(handle)
    got = [x for f in log.handleInputRows((1,), iter([rows((5, 9), (5, 2)), rows((1, 7), (6, 1))]), Times(0)) for x in f["ids"]]
    assert got == [[2, 9, 1]] and len(handle.calls) == 3
    got = [x for f in log.handleInputRows((1,), iter([rows((2_000_007, 4))]), Times(0)) for x in f["ids"]]
    assert got == [[9, 1, 4]] and len(handle.calls) == 5
    first = handle.timers[0]
    list(log.handleExpiredTimer((1,), Times(first), Times(first)))  # a row came since
    assert handle.timers[1] == first + 2000 and handle.timers[1] % SILENCE_MS == first % SILENCE_MS + 2000
    list(log.handleExpiredTimer((1,), Times(first), Times(handle.timers[1])))
    assert log.held.value is None
