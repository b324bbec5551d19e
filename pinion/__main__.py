import sys

from pinion.cli import main

sys.exit(main())
