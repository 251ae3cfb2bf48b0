"""`python -m quernel.driver`: the line protocol on standard input and output."""

import sys

from pyspark.sql import SparkSession

from quernel.engine import Engine
from quernel.functions.shipping import ship
from quernel.streaming.batches import serve


def main() -> None:
    spark = SparkSession.builder.appName("quernel").config("spark.scheduler.mode", "FAIR").getOrCreate()
    ship(spark)
    for line in serve(Engine(spark), sys.stdin):
        print(line, flush=True)


if __name__ == "__main__":
    main()
