"""Outputs: what is written (a strategy), where it goes (A2M, parts, one file a sequence), and who is told about it.

A strategy makes the rows of an alignment from a graph; ``register`` adds one under a name. A ``Listener`` hears of nodes and
sequences while they are handled and of how commands have ended; a user overrides what they need.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from ..functions.progress import Counter, watched
from . import sinks

if TYPE_CHECKING:
    from ..plans.graph import Graph

log = logging.getLogger("strandloom")
Strategy = Callable[..., DataFrame]
STRATEGIES: dict[str, Strategy] = {}


class Listener:
    """Told on the driver; the methods here log, and a command that fails is an error."""

    #: A line for so many records, nodes or sequences.
    RECORDS = NODES = 1_000_000
    SEQUENCES = 10

    def handled_records(self, n: int, total: int | None) -> None:
        log.info("handled %s records", n)

    def handled_node(self, n: int, total: int | None) -> None:
        log.info("handled %s/%s nodes", n, total)

    def handled_sequences(self, n: int, total: int | None) -> None:
        log.info("handled %s/%s sequences", n, total)

    def will_handle_sequence(self, seq_id: str) -> None:
        log.info("sequence %s", seq_id)

    def unable_to_execute(self, command: str, target: str, reason: str) -> None:
        raise RuntimeError(f"{command} {target} could not be run: {reason}")

    def exited(self, command: str, target: str, status: int) -> None:
        """``status`` as the system reports it: 0 for success, negative for a signal."""
        if status:
            raise RuntimeError(f"{command} {target} ended with {status}")

    def ended(self, command: str, target: str, status: int | None, reason: str | None) -> None:
        if status is None:
            self.unable_to_execute(command, target, reason or "")
        else:
            self.exited(command, target, status)


def register(name: str) -> Callable[[Strategy], Strategy]:
    """Adds a strategy: a function of a graph and options that returns the rows of an alignment."""

    def keep(f: Strategy) -> Strategy:
        STRATEGIES[name] = f
        return f

    return keep


@register("haplotypes")
def haplotypes(graph: Graph, **how) -> DataFrame:
    return graph.haplotypes(**how)


@register("founders")
def founders(graph: Graph, *, cuts: DataFrame, assignments: DataFrame, **how) -> DataFrame:
    return graph.founder_rows(cuts, assignments, **how)


@dataclass
class Output:
    """Writes what a strategy makes of a graph."""

    strategy: str | Strategy
    aligned: bool = True
    reference: bool = True
    chromosome: str | None = None
    command: str | None = None
    listener: Listener = field(default_factory=Listener)

    def rows(self, graph: Graph, **options) -> DataFrame:
        make = STRATEGIES[self.strategy] if isinstance(self.strategy, str) else self.strategy
        return make(graph, aligned=self.aligned, reference=self.reference, chromosome=self.chromosome, **options)

    def a2m(self, msa: DataFrame, path: str) -> None:
        """One A2M file: by all executors at once, or through the command's standard input, which the driver writes."""
        if self.command is None:
            self._counted(msa, lambda count: sinks.write_a2m_at_once(msa, path, count))
            return
        status, reason = sinks.pipe_a2m(msa, path, self.command, self.listener)
        self.listener.ended(self.command, path, status, reason)

    def parts(self, msa: DataFrame, folder: str) -> None:
        sinks.write_a2m_parts(msa, folder)

    def separate(self, msa: DataFrame, folder: str, *, a2m: bool = True) -> list[str]:
        """One file a sequence; returns their names (one row a sequence reaches the driver)."""
        files: list[str] = []

        def write(count: Counter) -> None:
            rows = sinks.write_separate(msa, folder, chromosome=self.chromosome, a2m=a2m, aligned=self.aligned, command=self.command, strict=False, count=count)
            for r in rows.collect():
                files.append(r["file"])
                if self.command:
                    self.listener.ended(self.command, r["file"], r["status"], r["reason"])

        self._counted(msa, write)
        return files

    def _counted(self, msa: DataFrame, write: Callable[[Counter], None]) -> None:
        sequences = msa.select("chrom", "seq_no", "seq_id").distinct()
        names = sequences.orderBy("chrom", "seq_no").toLocalIterator()
        total = 0
        for r in names:
            self.listener.will_handle_sequence(r["seq_id"])
            total += 1
        count = Counter(msa.sparkSession)
        with watched(count, self.listener.SEQUENCES, self.listener.handled_sequences, total):
            write(count)
