import sys

from rivulet.cli import main

sys.exit(main())
