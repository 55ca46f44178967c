import sys

from swathkit.cli import main

sys.exit(main(sys.argv[1:]))
