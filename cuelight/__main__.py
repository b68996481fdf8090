import sys

from cuelight.cli import main

sys.exit(main())
