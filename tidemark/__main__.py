from tidemark.plans.cli import main

main()
