"""``python -m rollcall <award|report|photos|setup> ...``"""

from rollcall.plans.cli import main

if __name__ == "__main__":
    main()
