"""``python -m panelwise``: the jobs from the command line, see ``panelwise.jobs``."""

from panelwise.jobs import main

raise SystemExit(main())
