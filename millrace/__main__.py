"""``python -m millrace ROOT``: a shell over the tables below ROOT; statements end at a line with a semicolon."""

import sys

from millrace.plans.engine import Engine, shell
from millrace.session import build_session


def main() -> None:
    if len(sys.argv) != 2:
        sys.exit(__doc__)
    spark = build_session("shell")
    spark.sparkContext.setLogLevel("ERROR")
    shell(Engine(spark, sys.argv[1]), sys.stdin)


if __name__ == "__main__":
    main()
