"""DataFrame operators. Each takes column names as parameters and stays lazy unless it says otherwise."""
