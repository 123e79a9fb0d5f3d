import sys

from netloom.cli import main

sys.exit(main())
