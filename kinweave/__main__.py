"""python -m kinweave STAGE --data FOLDER --work FOLDER: the stages of kinweave.plans.stages from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kinweave.plans import stages


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kinweave", description="Links records of three sources, stage by stage.")
    parser.add_argument("stage", choices=["prepare", "block", "train", "predict", "diagnose"])
    parser.add_argument("--data", required=True, help="folder of the source and truth files")
    parser.add_argument("--work", required=True, help="folder for what the stages write, shared by driver and executors")
    parser.add_argument("--out", help="folder of the list files (predict); <work>/out if not given")
    parser.add_argument("--split", default=None, help="train or test; block does both and predict test if not given")
    parser.add_argument("--top-k", type=int, default=10)
    parser.add_argument("--max-df", type=int, default=300)
    parser.add_argument("--share", type=float, default=0.25, help="share of the targets to train on")
    parser.add_argument("--rounds", type=int, default=40)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"kinweave {given.stage}").getOrCreate()
    if given.stage == "prepare":
        stages.prepare(spark, given.data, given.work)
    elif given.stage == "block":
        for split in [given.split] if given.split else ["train", "test"]:
            found = stages.block(spark, given.data, given.work, split, given.top_k, given.max_df)
            if found is not None:
                found.show(truncate=False)
    elif given.stage == "train":
        print(f"macro F0.5 of the reported fold: {stages.train(spark, given.data, given.work, given.share, given.rounds):.4f}")
    elif given.stage == "predict":
        stages.predict(spark, given.work, given.out or f"{given.work}/out", given.split or "test").show()
    else:
        for name, table in stages.report(spark, given.data, given.work).items():
            print(name)
            table.show(60, truncate=60)


if __name__ == "__main__":
    main()
