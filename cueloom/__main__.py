import sys

from cueloom.jobs import main

sys.exit(main())
