"""Post-market safety surveillance over device adverse-event reports, as Spark DataFrame plans."""
