"""The plan of a run: fragments in, routed fragments, records and metrics out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from readroute.operators import metrics
from readroute.operators.assemble import Declared, assemble, destinations, outputs, parts_bodies
from readroute.operators.extract import extract
from readroute.operators.match import match_groups
from readroute.operators.route import route
from readroute.plans.spec import Spec, SpecError
from readroute.sources.sinks import output_format, sam_header


@dataclass
class Demux:
    """A lazily planned run over (fid, reads) fragments with `files` reads each.

    `inputs`: input files, 1 if one file holds both mates (by default as many as reads);
    `kinds`: their formats.
    """

    fragments: DataFrame
    spec: Spec
    files: int
    inputs: int | None = None
    kinds: Sequence[str] = ("fastq",)

    @property
    def kind(self) -> str:
        """The format of assigned fragments."""
        return output_format(self.spec.out or "-", self.kinds)

    def matched(self) -> DataFrame:
        return match_groups(self.fragments, self.spec, self.files)

    def extracted(self) -> DataFrame:
        return extract(self.matched(), self.spec)

    def routed(self) -> DataFrame:
        """Fragments with their matches, streams and disposition."""
        return route(self.extracted(), self.spec)

    def records(self) -> DataFrame:
        """A row for each output record, with its destination."""
        if self.spec.out and parts_bodies(self.spec, self.files, self.kind) and "%ordinal" not in self.spec.out:
            raise SpecError(f"{self.spec.out}: several reads of a fragment go to FASTQ or FASTA files of their own, so %ordinal is needed")
        return outputs(assemble(self.routed(), self.spec), self.spec, self.files, self.inputs, self.kind)

    def declared(self) -> dict[str, Declared]:
        """Every destination, with what it may get; without a pattern `out` stands for the standard output."""
        return destinations(self.spec, self.files, self.inputs or self.files, self.kind)

    def destinations(self) -> list[str]:
        """Every destination that the patterns declare."""
        return [d for d in self.declared() if d != "out" or self.spec.out is not None]

    def headers(self, version: str, command: str) -> dict[str, list[str]]:
        """The lines that a SAM file of each destination begins with."""
        return {d: sam_header(self.spec, own, version, command) for d, own in self.declared().items()}

    def totals(self) -> DataFrame:
        """The counts behind both reports, from one pass over the fragments."""
        return metrics.totals(metrics.with_unextracted(self.routed(), self.spec, self.files), self.files)

    def per_sample(self, totals: DataFrame | None = None) -> DataFrame:
        return metrics.per_sample(totals or self.totals(), self.spec)

    def summary(self, totals: DataFrame | None = None) -> DataFrame:
        return metrics.summary(totals or self.totals(), self.spec, self.files)
