"""Command line: probe, calibrate, extract and preview on a folder of frames (image files with their number in the name)."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tenfold.operators import board, calibrate, report
from tenfold.sources import frames


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tenfold", description=__doc__)
    jobs = p.add_subparsers(dest="job", required=True)
    for name, text in (("probe", "size and length"), ("calibrate", "clusters of marks, or with --labels a bank"), ("extract", "the reports of all frames"), ("preview", "one frame's cells")):
        j = jobs.add_parser(name, help=text)
        j.add_argument("frames")
        j.add_argument("--fps", type=float, default=25.0)
        j.add_argument("--every", type=int, default=2)
        j.add_argument("--limit", type=int)
        j.add_argument("--bank")
        j.add_argument("--out", default="out")
        j.add_argument("--frame", type=int, default=0)
        j.add_argument("--labels", help="JSON of cluster numbers and labels")
        j.add_argument("--keep-printed", action="store_true", help="leave printed sums as they are")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "calibrate" and args.labels:
        typed = calibrate.parsed_labels(spark.read.text(args.labels, wholetext=True))
        frames.write_bank(board.bank_of(args.out, typed), args.bank or f"{args.out}/bank")
        return
    all_frames = frames.images(spark, args.frames)
    some = frames.sampled(all_frames, "frame_index", args.every, limit=args.limit)
    video = frames.described(all_frames, args.frames, args.fps)
    if args.job == "probe":
        video.show(truncate=False)
    elif args.job == "calibrate":
        board.clustered(board.detected(some), args.out).select("cluster_id", "count", "roles", "label").show(100, truncate=False)
    elif args.job == "preview":
        frames.one(all_frames, "frame_index", args.frame)
        found, cells = board.preview(all_frames, args.frame, frames.read_bank(spark, args.bank) if args.bank else None)
        found.select("ok", "reason", "n_h_lines", "n_v_lines").show(truncate=False)
        cells.show(100, truncate=False)
    else:
        if not args.bank:
            raise ValueError("extract needs --bank")
        result = board.extract(some, frames.read_bank(spark, args.bank), not args.keep_printed)
        report.write_csv(result.players, "initial", f"{args.out}/csv")
        board.document(result, video).write.mode("overwrite").text(f"{args.out}/json")
        print(board.summary(result))


def main(argv: list[str] | None = None) -> int:
    """0, or 1 with a message where frames, a bank or a board are missing."""
    args = parser().parse_args(argv)
    try:
        run(SparkSession.builder.appName("tenfold").getOrCreate(), args)
    except (FileNotFoundError, ValueError, IndexError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
