"""Mail as a stream: messages from an IMAP mailbox or from .eml files that land in a folder.

The IMAP reader is a Spark data source; its offset is the last message number, so a batch
can be read again after a failure. The driver only asks for that number: the numbers of a
batch are cut into blocks, and each block's messages are fetched and parsed by a task.
Register it with ``spark.dataSource.register(Mailbox)`` and read ``format("imap")`` with the
options host, user, password, folder and block (message numbers a task, 200).
"""

from __future__ import annotations

import email
import email.policy
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "uid string, sender string, subject string, attachments array<struct<filename: string, payload: binary>>, error string"


def parse_message(uid: str, raw: bytes) -> tuple:
    """(uid, sender, subject, attachments, error); a message that can't be read has an error."""
    try:
        m = email.message_from_bytes(raw, policy=email.policy.default)
        parts = [(p.get_filename(), p.get_payload(decode=True) or b"") for p in m.iter_attachments() if p.get_filename()]
        return uid, str(m["from"] or ""), str(m["subject"] or ""), parts, None
    except Exception as e:  # noqa: BLE001  one message's failure is its own
        return uid, None, None, [], f"{type(e).__name__}: {e}"


def _message_rows(batches):
    names = ("uid", "sender", "subject", "attachments", "error")
    files = pa.list_(pa.struct([("filename", pa.string()), ("payload", pa.binary())]))
    kinds = (pa.string(), pa.string(), pa.string(), files, pa.string())
    for batch in batches:
        rows = [parse_message(path, raw) for path, raw in zip(*(c.to_pylist() for c in batch.columns))]
        rows = [(*r[:3], [{"filename": n, "payload": p} for n, p in r[3]], r[4]) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def eml_files(files: DataFrame) -> DataFrame:
    """Messages of binary files (path, content), streaming or not."""
    return files.select("path", "content").mapInArrow(_message_rows, SCHEMA)


def eml_stream(spark: SparkSession, path: str) -> DataFrame:
    at = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*.eml").load(path)
    return eml_files(at.where(F.col("length") > 0))


class MailboxReader(SimpleDataSourceStreamReader):
    """Messages between two offsets, in one process: a block of a batch."""

    def __init__(self, options: dict, connect=None):
        self.options, self.connect = options, connect

    def _open(self):
        import imaplib

        box = self.connect() if self.connect else imaplib.IMAP4_SSL(self.options["host"], int(self.options.get("port", 993)))
        if not self.connect:
            box.login(self.options["user"], self.options["password"])
        box.select(self.options.get("folder", "INBOX"), readonly=True)
        return box

    def initialOffset(self) -> dict:
        return {"uid": 0}

    def _fetch(self, box, after: int, upto: int | None = None):
        _, found = box.uid("search", None, f"UID {after + 1}:{upto or '*'}")
        for uid in sorted(int(u) for u in found[0].split()):
            if uid > after and (upto is None or uid <= upto):  # "*" also names the last one before
                _, data = box.uid("fetch", str(uid), "(BODY.PEEK[])")
                yield uid, parse_message(str(uid), data[0][1])

    def read(self, start: dict):
        box = self._open()
        got = list(self._fetch(box, start["uid"]))
        return iter([m for _, m in got]), {"uid": max([u for u, _ in got], default=start["uid"])}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([m for _, m in self._fetch(self._open(), start["uid"], end["uid"])])

    def commit(self, end: dict) -> None:
        """The offset in the checkpoint is the memory of what was read."""


@dataclass
class Block(InputPartition):
    """Message numbers above ``low``, up to ``high``."""

    low: int
    high: int


class MailboxStream(DataSourceStreamReader):
    """A batch of any size: the driver learns the last message number, tasks read the blocks.
    A mailbox that was numbered anew (another UIDVALIDITY) fails instead of losing messages."""

    def __init__(self, options: dict, connect=None):
        self.options, self.reader = options, MailboxReader(options, connect)

    def initialOffset(self) -> dict:
        return {"uid": 0, "validity": 0}

    def latestOffset(self) -> dict:
        box = self.reader._open()
        _, found = box.status(self.options.get("folder", "INBOX"), "(UIDNEXT UIDVALIDITY)")
        at = {k: int(v) for k, v in re.findall(r"(UIDNEXT|UIDVALIDITY) (\d+)", found[0].decode())}
        box.logout()
        return {"uid": at["UIDNEXT"] - 1, "validity": at["UIDVALIDITY"]}

    def partitions(self, start: dict, end: dict) -> list[Block]:
        if start["validity"] not in (0, end["validity"]):
            raise ValueError("the mailbox was numbered anew; start from another checkpoint")
        wide = int(self.options.get("block", 200))
        return [Block(low, min(low + wide, end["uid"])) for low in range(start["uid"], end["uid"], wide)]

    def read(self, partition: Block):
        return self.reader.readBetweenOffsets({"uid": partition.low}, {"uid": partition.high})

    def commit(self, end: dict) -> None:
        """The offset in the checkpoint is the memory of what was read."""


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imap"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return MailboxStream(dict(self.options))
