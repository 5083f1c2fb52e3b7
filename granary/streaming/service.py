"""The request service as keyed streaming state: steps, buttons, consent, expiry without a new event, rate limit.

Events wait in the state of their user until the watermark has passed them and are then
taken in order of time, so the outcome depends neither on the cut into micro-batches nor
on the order of arrival. A timer for the end of a dialog's life ends it when no event comes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import comment, person_name, phone_strict

SECOND = 1_000_000  # microseconds
HOUR = 3600 * SECOND
CHUNK = 1000  # events in one entry of the state
EVENT = ("at", "event_id", "kind", "payload", "name", "phone", "comment")
TICK = "tick"  # an event of this kind only moves the watermark
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "user_id long, ts timestamp, event_id long, outcome string, step string, service string, name string, phone string, comment string, consent_at timestamp"
REQUIRED = ("consent_at", "service", "name", "phone")
ASKS = {"consent": "ask_consent", "service": "ask_service", "name": "ask_name", "phone": "ask_phone", "comment": "ask_comment", "confirm": "ask_confirm"}


@dataclass
class Dialog:
    step: str
    updated: int
    answers: dict[str, str] = field(default_factory=dict)


def reply(dialog: Dialog | None, accepted: list[int], event: dict, services: dict[str, str], limit: int) -> tuple[str, Dialog | None, list[int], dict | None]:
    """Outcome of an event, the dialog and the times of accepted requests after it, and the request if one is accepted.

    ``event``: kind (start, cancel, forget, text, contact, button, other), payload, at, and what
    the payload is as a name, phone and comment (null: none). Only steps that are taken keep a dialog alive.
    """
    kind, payload, at = event["kind"], event["payload"] or "", event["at"]
    recent = [t for t in accepted if at - t < HOUR]

    def to(step: str, **answers: str) -> tuple[str, Dialog, list[int], None]:
        return ASKS[step], Dialog(step, at, {**(dialog.answers if dialog else {}), **answers}), accepted, None

    if kind == "button" and payload in ("start", "cancel"):
        kind = payload
    if kind == "start":
        dialog = None
        return ("limited", None, accepted, None) if len(recent) >= limit else to("consent")
    if kind == "cancel":
        return "cancelled", None, accepted, None
    if kind == "forget":
        return "forgotten", None, [], None
    if dialog is None:
        return ("stale" if kind == "button" else "idle"), None, accepted, None

    stay = lambda outcome: (outcome, dialog, accepted, None)
    if kind == "button":
        if dialog.step == "consent" and payload == "consent:yes":
            return to("service", consent_at=str(at))
        if dialog.step == "consent" and payload == "consent:no":
            return "declined", None, accepted, None
        if dialog.step == "service" and payload.startswith("service:") and payload[8:] in services:
            return to("name", service=payload[8:])
        if dialog.step == "comment" and payload == "skip":
            return to("confirm", comment="")
        if dialog.step == "confirm" and payload == "edit":
            return ASKS["service"], Dialog("service", at, {"consent_at": dialog.answers["consent_at"]}), accepted, None
        if dialog.step == "confirm" and payload == "send":
            if any(not dialog.answers.get(k) for k in REQUIRED):
                return "stale", None, accepted, None
            if len(recent) >= limit:
                return "limited", None, accepted, None
            return "accepted", None, [*recent, at], dialog.answers
        return stay("stale")
    if kind == "contact" and dialog.step != "phone" or kind == "other":
        return stay({"consent": "consent_required", "confirm": "use_buttons"}.get(dialog.step, ASKS[dialog.step]))
    if dialog.step == "consent":
        return stay("consent_required")
    if dialog.step == "service":
        chosen = next((k for k, title in services.items() if title.casefold() == payload.strip().casefold()), None)
        return to("name", service=chosen) if chosen else stay("use_buttons")
    if dialog.step == "name":
        return to("phone", name=event["name"]) if event["name"] else stay("invalid_name")
    if dialog.step == "phone":
        return to("comment", phone=event["phone"]) if event["phone"] else stay("invalid_phone")
    if dialog.step == "comment":
        return to("confirm", comment=event["comment"]) if event["comment"] is not None else stay("comment_too_long")
    return stay("use_buttons")


class Service(StatefulProcessor):
    """State of a user: the dialog with the times of accepted requests, and events that wait for the watermark.

    A user has one timer, at what comes first: the earliest of the waiting events or the end
    of the dialog. It takes all events that the watermark has passed, so the calls of the state
    grow with users and micro-batches, not with events.
    """

    def __init__(self, services: dict[str, str], limit: int, ttl: int):
        self.services, self.limit, self.ttl = services, limit, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "dialog string")
        self.waiting = handle.getListState("waiting", "events string")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, events = None, []
        for r in rows:
            if r.kind == TICK:
                continue
            events.append([r[k] for k in EVENT])
            first = r.at if first is None else min(first, r.at)
            if len(events) == CHUNK:
                self.waiting.appendValue((json.dumps(events),))
                events = []
        if events:
            self.waiting.appendValue((json.dumps(events),))
        if first is not None:
            at, known = self._after(first - 1), self.timer.get()
            if known is None or at < known[0]:
                if known is not None:
                    self.handle.deleteTimer(known[0])
                self._wake(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for (text,) in self.waiting.get():
            for e in json.loads(text):
                (due if e[0] <= passed else later).append(e)
        kept = self.kept.get()
        dialog, accepted = json.loads(kept[0]) if kept is not None else (None, [])
        dialog, out = dialog and Dialog(*dialog), []

        def expire(now: int) -> None:
            nonlocal dialog
            if dialog is not None and now - dialog.updated > self.ttl:
                out.append(self._row(key, dialog.updated + self.ttl, None, "expired", dialog.step, {}))
                dialog = None

        for values in sorted(due, key=lambda e: e[:2]):
            e = dict(zip(EVENT, values, strict=True))
            expire(e["at"])
            outcome, dialog, accepted, request = reply(dialog, accepted, e, self.services, self.limit)
            out.append(self._row(key, e["at"], e["event_id"], outcome, dialog.step if dialog else None, request or {}))
        expire(passed)
        if due:
            self.waiting.clear()
            for k in range(0, len(later), CHUNK):
                self.waiting.appendValue((json.dumps(later[k : k + CHUNK]),))
        if dialog is not None or accepted:
            self.kept.update((json.dumps([dialog and [dialog.step, dialog.updated, dialog.answers], accepted]),))
        elif kept is not None:
            self.kept.clear()
        ends = [self._after(e[0] - 1) for e in later] + ([self._after(dialog.updated + self.ttl)] if dialog else [])
        self._wake(min(ends, default=None))
        return iter(out)

    def _wake(self, at: int | None) -> None:
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    @staticmethod
    def _after(micros: int) -> int:
        """The first whole millisecond after a moment."""
        return micros // 1000 + 1

    @staticmethod
    def _row(key, at: int, event_id: int | None, outcome: str, step: str | None, request: dict) -> Row:
        moment = lambda t: None if t is None else _moment(int(t))
        return Row(user_id=key[0], ts=moment(at), event_id=event_id, outcome=outcome, step=step, service=request.get("service"), name=request.get("name"), phone=request.get("phone"), comment=request.get("comment"), consent_at=moment(request.get("consent_at")))


def _moment(at: int):
    import datetime as dt

    return dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=at)


def serve(events: DataFrame, services: dict[str, str], ttl_seconds: int = 24 * 3600, limit: int = 3, delay: str = "1 hour", longest_comment: int = 1000) -> DataFrame:
    """Outcome of every event (event_id, user_id, ts, kind, payload) of a stream, accepted requests with
    their answers, and a row ``expired`` (without event) for each dialog that nobody went on with.

    Events may arrive up to ``delay`` late; later ones are dropped, as the watermark has passed
    them. Events of one moment go by number. The last ones come out when later events, or a ``tick``, have
    moved the watermark. The state needs RocksDB, which is set for the session.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    read = events.withWatermark("ts", delay).select(
        "user_id", "event_id", "kind", "payload", "ts", F.unix_micros("ts").alias("at"),
        person_name(F.col("payload"))["value"].alias("name"), phone_strict(F.col("payload"))["value"].alias("phone"), comment(F.coalesce("payload", F.lit("")), longest_comment)["value"].alias("comment"),
    )
    return read.groupBy("user_id").transformWithState(Service(services, limit, ttl_seconds * SECOND), OUTPUT, "Append", "EventTime")
