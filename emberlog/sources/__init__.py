"""Sources: failure reports and run stores."""
