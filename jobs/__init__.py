"""Jobs: work that is run again and again over tables that grow, each with a command line and a config file."""
