"""DataFrame operators; a fit returns small parameters, everything else is lazy."""
