import sys

from terrane.plans.commands import main

sys.exit(main())
