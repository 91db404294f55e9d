"""Command line: python -m anchorspan.cli FORMAT CHAIN INPUT [...]"""

from __future__ import annotations

import argparse
import sys

from anchorspan.functions.chrom import parse_style
from anchorspan.session import local_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="anchorspan", description="Lift genomic records from one assembly to another.")
    top.add_argument("--compat-mode", choices=["improved", "strict"], default="improved", help="kept for old scripts; changes no result")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *places: str, output: bool = True, default: str | None = None) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("chain")
        for place in ("input", *places):
            p.add_argument(place)
        if output:
            p.add_argument("output", nargs="?", default=default)
        p.add_argument("-t", "--threads", type=int, default=0, help="local threads; 0 takes all cores")
        p.add_argument("--chromid", type=parse_style, default="a", help="a as it is, s short, l long")
        p.add_argument("--folder", action="store_true", help="write a folder of parts instead of one file")
        return p

    command("bed", default="output.bed")
    command("gff", default="output.gff")
    for name in ("vcf", "gvcf"):
        p = command(name, "ref", default=f"output.{name}")
        p.add_argument("--no-comp-allele", action="store_true")
    command("maf", "ref", default="output.maf").add_argument("-b", "--build", required=True)
    command("wig", default="output")
    command("bigwig", default="output.bw")
    command("bam", "output", output=False)
    command("region", default="output.bed").add_argument("-r", "--min-ratio", type=float, default=0.85)
    return top


def main(args: list[str] | None = None) -> dict[str, int]:
    from anchorspan.plans import files

    a = parser().parse_args(args)
    spark = local_session(a.threads or "*")
    single = not a.folder
    if a.command == "bed":
        got = files.convert_bed(spark, a.chain, a.input, a.output, a.chromid, single)
    elif a.command == "gff":
        got = files.convert_gff(spark, a.chain, a.input, a.output, a.chromid, single)
    elif a.command in ("vcf", "gvcf"):
        got = files.convert_vcf(spark, a.chain, a.input, a.ref, a.output, a.chromid, a.command == "gvcf", a.no_comp_allele, single)
    elif a.command == "maf":
        got = files.convert_maf(spark, a.chain, a.input, a.ref, a.build, a.output, a.chromid, single)
    elif a.command == "wig":
        got = files.convert_wig(spark, a.chain, a.input, a.output, a.chromid)
    elif a.command == "bigwig":
        got = files.convert_bigwig(spark, a.chain, a.input, a.output, a.chromid)
    elif a.command == "bam":
        got = files.convert_alignments(spark, a.chain, a.input, a.output, a.chromid)
    else:
        got = files.convert_region(spark, a.chain, a.input, a.output, a.chromid, a.min_ratio, single)
    for name, n in got.items():
        print(f"{name}: {n}", file=sys.stderr)
    return got


if __name__ == "__main__":
    main()
