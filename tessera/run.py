"""An extraction in a thread of its own, for front ends: input checks, messages, cancel.

Messages, in order: ("log", line, tag), ("progress", pos, total, title, is_chapter),
and at last ("result", ExtractResult) or ("error", traceback).
"""

from __future__ import annotations

import os
import queue
import threading
import traceback
import uuid
from pathlib import Path

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from .extract import ExtractResult, extract_epub
from .operators import book
from .operators.sink import make_folder


def log_tag(line: str) -> str | None:
    """``book.log_tag`` of one line."""
    plain = line.strip().lower()
    if not plain:
        return None
    return "success" if plain.startswith("wrote") and "chapter" in plain else "error" if "cancelled" in plain else "text"


class Run:
    """``start`` it once; one run of a process is active at a time."""

    _active: Run | None = None
    _lock = threading.Lock()

    def __init__(self, spark: SparkSession, epub_path: str, out_dir: str, cfg: book.Config = book.Config()) -> None:
        self.spark, self.epub_path, self.out_dir, self.cfg = spark, epub_path.strip(), out_dir.strip(), cfg
        self.messages: queue.Queue[tuple] = queue.Queue()
        self.state = "ready"
        self._tag, self._cancelled = f"tessera-{uuid.uuid4().hex}", threading.Event()
        self._thread = InheritableThread(target=self._work, session=spark)

    def start(self) -> None:
        """Begin, or raise ValueError if the input is not fit or another run is active."""
        if not os.path.isfile(self.epub_path):
            raise ValueError(f"no such EPUB file: {self.epub_path or '(none given)'}")
        if not self.out_dir:
            raise ValueError("no output folder given")
        try:
            make_folder(self.out_dir)
        except OSError as e:
            raise ValueError(f"cannot make the output folder {self.out_dir}: {e}") from e
        with Run._lock:
            if Run._active is not None:
                raise ValueError("another extraction is running")
            Run._active = self
        self.state = "running"
        self._thread.start()

    def cancel(self) -> None:
        """Stop before the next item, and stop the Spark jobs of this run."""
        self._cancelled.set()
        self.spark.interruptTag(self._tag)

    def wait(self) -> str:
        """How the run ended: completed, failed or cancelled."""
        self._thread.join()
        return self.state

    def _work(self) -> None:
        pos = 0

        def progress(at: int, *more) -> None:
            nonlocal pos
            pos = at
            self.messages.put(("progress", at, *more))

        def log(line: str) -> None:
            self.messages.put(("log", line, log_tag(line)))

        try:
            self.spark.addTag(self._tag)
            result = extract_epub(self.spark, self.epub_path, self.out_dir, self.cfg, log, progress, self._cancelled.is_set)
            if self.cfg.classify and not result.cancelled and not result.chapter_count and result.non_chapter_count:
                log(book.HINT % result.non_chapter_count)
            self.state = "cancelled" if result.cancelled else "completed" if result.chapter_count + result.non_chapter_count else "failed"
            self.messages.put(("result", result))
        except Exception:  # noqa: BLE001  a front end shows it
            if self._cancelled.is_set():
                log(book.CANCELLED)
                self.state = "cancelled"
                self.messages.put(("result", ExtractResult(Path(self.out_dir), pos, 0, 0, cancelled=True)))
            else:
                self.state = "failed"
                self.messages.put(("error", traceback.format_exc()))
        finally:
            self.spark.removeTag(self._tag)
            with Run._lock:
                Run._active = None
