"""tidelog.functions"""
