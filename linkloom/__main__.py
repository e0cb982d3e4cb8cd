"""python -m linkloom MODE --data-dir D --work-dir W: the linkage run, step by step or as a whole."""

from __future__ import annotations

import argparse

MODES = ("train", "prep-train", "test-prep", "assign", "all", "diag", "block")


def main(args: list[str] | None = None, spark=None) -> None:
    parser = argparse.ArgumentParser(prog="linkloom")
    parser.add_argument("mode", choices=MODES)
    parser.add_argument("--data-dir", required=True, help="holds train/ and test/")
    parser.add_argument("--work-dir", required=True, help="every step's table; what is there is not computed again")
    parser.add_argument("--split", choices=["train", "test"], default="test", help="block: which split")
    parser.add_argument("--countries", help="only these, comma-separated")
    parser.add_argument("--method", choices=["threshold", "expected"], default="threshold")
    parser.add_argument("--rounds", type=int, default=40)
    opts = parser.parse_args(args)
    from linkloom.plans.linkage import Linkage
    from linkloom.session import local_session

    run = Linkage(spark or local_session(), opts.data_dir, opts.work_dir, rounds=opts.rounds, countries=opts.countries.split(",") if opts.countries else None)
    if opts.mode == "diag":
        run.diagnose().show(truncate=False)
    if opts.mode == "block":
        run.candidates(opts.split)
    if opts.mode in ("prep-train", "train", "all"):
        run.features("train")
    if opts.mode in ("train", "all"):
        run.train().show(50, truncate=False)
    if opts.mode in ("test-prep", "all"):
        run.features("test")
    if opts.mode in ("assign", "all"):
        run.assign("test", opts.method)


if __name__ == "__main__":
    main()
