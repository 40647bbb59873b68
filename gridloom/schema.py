"""Explicit schemas of the interval tables. Coordinates are half-open and long; missing values are null, never NaN."""

from __future__ import annotations

FRAGMENTS = "contig string, start long, end long, barcode string, count int"
INTERVALS = "contig string, start long, end long, value double"
REGIONS = "contig string, start long, end long"
READS = "contig string, start long, end long, flag int, mapq int, tlen long, sample string"
PEAKS = "contig string, start long, end long, name string, score int, strand string, signal double, p double, q double, summit_offset int"
CONTIGS = "contig string, size long, ord int"

#: Bins per tile: order-dependent work is done per (contig, tile) with exact carries, never per contig.
TILE = 4096
