"""Statement analytics, Monte Carlo and relational operators as Spark plans."""
