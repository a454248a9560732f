import sys

from lumenframe.plans.pipeline import main

sys.exit(main(sys.argv[1:]))
