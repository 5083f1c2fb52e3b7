"""The request service: scenarios worked by hand, replays in different micro-batches, sinks after a failure."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from granary.streaming import service, sinks

SERVICES = {"doors": "Doors", "repair": "Repair works"}
SCHEMA = "event_id long, user_id long, ts timestamp, kind string, payload string"
START = dt.datetime(2024, 1, 1)


def event(kind, payload="", at=0, name=None, phone=None, comment=""):
    return {"kind": kind, "payload": payload, "at": at * service.SECOND, "name": name, "phone": phone, "comment": comment}


def play(events, limit=3):
    dialog, accepted, outcomes, requests = None, [], [], []
    for e in events:
        outcome, dialog, accepted, request = service.reply(dialog, accepted, e, SERVICES, limit)
        outcomes.append(outcome)
        requests += [request] if request else []
    return outcomes, requests


WHOLE = [event("start"), event("button", "consent:yes", 1), event("button", "service:doors", 2), event("text", "Anna", 3, name="Anna"), event("contact", "+79991234567", 4, phone="+79991234567"), event("button", "skip", 5), event("button", "send", 6)]


def test_whole_scenario():
    outcomes, requests = play(WHOLE)
    assert outcomes == ["ask_consent", "ask_service", "ask_name", "ask_phone", "ask_comment", "ask_confirm", "accepted"]
    assert requests == [{"consent_at": str(service.SECOND), "service": "doors", "name": "Anna", "phone": "+79991234567", "comment": ""}]


@pytest.mark.parametrize(
    "events, want",
    [
        ([event("text", "hi"), event("button", "send"), event("contact", "x"), event("other")], ["idle", "stale", "idle", "idle"]),
        ([event("start"), event("text", "Anna", name="Anna"), event("other"), event("button", "send"), event("button", "consent:no"), event("text", "x")], ["ask_consent", "consent_required", "consent_required", "stale", "declined", "idle"]),
        ([*WHOLE[:2], event("text", " repair WORKS "), event("button", "service:doors")], ["ask_consent", "ask_service", "ask_name", "stale"]),
        ([*WHOLE[:2], event("text", "windows"), event("button", "service:none"), event("contact", "+7")], ["ask_consent", "ask_service", "use_buttons", "stale", "ask_service"]),
        ([*WHOLE[:4], event("text", "12", name=None), event("text", "8 999", phone="+7999")], ["ask_consent", "ask_service", "ask_name", "ask_phone", "invalid_phone", "ask_comment"]),
        ([*WHOLE[:5], event("text", "long", comment=None), event("text", "call me", comment="call me"), event("text", "x"), event("button", "edit"), event("button", "service:repair")], ["ask_consent", "ask_service", "ask_name", "ask_phone", "ask_comment", "comment_too_long", "ask_confirm", "use_buttons", "ask_service", "ask_name"]),
        ([*WHOLE[:3], event("button", "cancel"), event("text", "Anna")], ["ask_consent", "ask_service", "ask_name", "cancelled", "idle"]),
        ([*WHOLE[:3], event("button", "start")], ["ask_consent", "ask_service", "ask_name", "ask_consent"]),
    ],
)
def test_turns(events, want):
    assert play(events)[0] == want


def test_limit_and_withdrawn_consent():
    outcomes, _ = play([*WHOLE, *WHOLE, event("start", at=100)], limit=2)
    assert outcomes[-1] == "limited" and outcomes.count("accepted") == 2
    assert play([*WHOLE, *WHOLE, event("start", at=3700)], limit=2)[0][-1] == "ask_consent"
    assert play([*WHOLE, *WHOLE, event("forget"), event("start", at=100)], limit=2)[0][-2:] == ["forgotten", "ask_consent"]


def course(seed, users, n):
    """Events of several users with wrong turns and long gaps."""
    r, rows = random.Random(seed), []
    good = {"consent": ("button", "consent:yes"), "service": ("button", "service:doors"), "name": ("text", "Anna Maria"), "phone": ("contact", "8 999 123-45-67"), "comment": ("text", "call"), "confirm": ("button", "send")}
    order = list(good)
    for user in range(users):
        at, k = START + dt.timedelta(seconds=r.randrange(3600)), 0
        for _ in range(n):
            at += dt.timedelta(seconds=r.choice([1, 1, 5, 30, 30, 60, 300, 600, 7200, 100_000]), microseconds=r.randrange(3))
            if k == 0 and r.random() < 0.9:
                rows.append((user, at, "start", None))
                k = 1
            elif r.random() < 0.9:
                rows.append((user, at, *good[order[(k - 1) % 6]]))
                k = (k + 1) % 7
            else:
                rows.append((user, at, *r.choice([("text", "?"), ("other", ""), ("button", "edit"), ("button", "start"), ("cancel", ""), ("forget", ""), ("contact", "12")])))
    rows.sort(key=lambda x: x[1])
    return [(k, *x) for k, x in enumerate(rows)]


def plain(rows, ttl, limit):
    """The service without Spark: users one by one, events in order, ends of dialogs in between."""
    out, end = [], START + dt.timedelta(days=400)
    micros = lambda t: int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    for user in sorted({x[1] for x in rows}):
        dialog, accepted = None, []
        for e in [*[x for x in rows if x[1] == user], (None, user, end, None, None)]:
            now = micros(e[2])
            if dialog and now - dialog.updated > ttl * service.SECOND:
                out.append((user, dialog.updated + ttl * service.SECOND, None, "expired", dialog.step, None))
                dialog = None
            if e[3] is None:
                continue
            text = e[4] or ""
            seen = {"kind": e[3], "payload": e[4], "at": now, "name": text if text.replace(" ", "").isalpha() and len(text) > 1 else None, "phone": "+79991234567" if text.startswith("8 999") else None, "comment": text}
            outcome, dialog, accepted, request = service.reply(dialog, accepted, seen, SERVICES, limit)
            out.append((user, now, e[0], outcome, dialog.step if dialog else None, request and request["phone"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("files, shuffled", [(1, False), (7, False), (5, True)])
def test_replay_does_not_depend_on_the_cut(spark, tmp_path, files, shuffled):
    rows, ttl = course(3, 5, 60), 5000
    last = (10**9, -1, START + dt.timedelta(days=400), service.TICK, None)
    source = tmp_path / "events"
    for k in range(files):
        part = rows[k * len(rows) // files : (k + 1) * len(rows) // files]
        if shuffled:
            random.Random(k).shuffle(part)
        spark.createDataFrame([*part, *([last] if k == files - 1 else [])], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    served = service.serve(stream, SERVICES, ttl_seconds=ttl, limit=2, delay="100 days" if shuffled else "1 second")
    path = str(tmp_path / "out")
    served.writeStream.foreachBatch(sinks.once(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    got = sinks.stored(spark, path).select("user_id", F.unix_micros("ts").alias("at"), "event_id", "outcome", "step", "phone", "consent_at").collect()
    assert sorted(((r.user_id, r["at"], r.event_id, r.outcome, r.step, r.phone) for r in got), key=str) == plain(rows, ttl, 2)
    assert {r.outcome for r in got} >= {"accepted", "expired", "idle", "stale"} and all((r.consent_at is not None) == (r.outcome == "accepted") for r in got)


def test_repeated_batch_adds_nothing(spark, tmp_path):
    source, path, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(str(source))
    write, failed = sinks.once(path), []

    def killed(rows, batch):
        write(rows, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("lost after the write, before the commit")

    def run():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(source))
        stream.writeStream.foreachBatch(killed).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    with pytest.raises(Exception):
        run()
    run()
    out = sinks.stored(spark, path)
    assert failed == [1] and sorted(r.id for r in out.collect()) == list(range(30)) and out.select("row").distinct().count() == 30
    first = out.filter("batch = 0")
    for _ in range(2):
        sinks.mark(first, marks, 0)
    assert sorted(r.id for r in sinks.untold(out, spark.read.parquet(marks)).collect()) == sorted(r.id for r in out.filter("batch > 0").collect())


class Counted:
    """Stands for the state: counts its calls and keeps one value, a list and the timers."""

    def __init__(self):
        self.calls, self.values, self.timers = 0, [], []

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name.startswith("get") and args:
                return Counted.part(self)
            if name == "registerTimer":
                self.timers.append(args[0])
            elif name == "deleteTimer":
                self.timers.remove(args[0])

        return call

    class part:
        def __init__(self, whole):
            self.whole, self.value, self.rows = whole, None, []

        def __getattr__(self, name):
            def call(*args):
                self.whole.calls += 1
                if name == "appendValue":
                    self.rows.append(args[0])
                elif name == "update":
                    self.value = args[0]
                elif name == "clear":
                    self.value, self.rows = None, []
                elif name == "get":
                    return self.value if self.value is not None else iter(self.rows) if self.rows else None

            return call


def test_calls_of_the_state_do_not_grow_with_events():
    class At:
        getCurrentWatermarkInMs = staticmethod(lambda: 10**9)
        getExpiryTimeInMs = staticmethod(lambda: 1)

    calls = []
    for n in (10, 500):
        state, served = Counted(), service.Service(SERVICES, 3, 5000 * service.SECOND)
        served.init(state)
        rows = [service.Row(event_id=k, at=k * service.SECOND, kind="text", payload="x", name=None, phone=None, comment="x") for k in range(n)]
        assert list(served.handleInputRows((1,), iter(rows), At)) == [] and len(state.timers) == 1
        assert [r.event_id for r in served.handleExpiredTimer((1,), At, At)] == list(range(n))
        calls.append(state.calls)
    assert calls[0] == calls[1] < 20
