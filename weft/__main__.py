from weft.cli import main

raise SystemExit(main())
